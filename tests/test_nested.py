"""Nested hold-outs against plain computations."""

import random

from fieldmark.operators.nested import NONE, calibrated_inside, chosen_inside, validation, withheld

LEVELS = {"all": [], "city": ["city"]}


def test_sums_leave_out_all_that_is_withheld(spark):
    rng = random.Random(4)
    cells = {(x, y): rng.choice([None, None, None, None, 0, 1, 2]) for x in range(14) for y in range(14) if rng.random() < 0.7}
    lists = {(c, city): rng.randint(1, 6) for c in cells for city in ("u", "v") if rng.random() < 0.6}
    hits = {(c, city, item): rng.randint(0, n) for (c, city), n in lists.items() for item in ("i", "j")}
    counts = [(*c, city, None, n) for (c, city), n in lists.items()] + [(*c, city, item, n) for (c, city, item), n in hits.items() if n]
    df = spark.createDataFrame(counts, "x long, y long, city string, item string, n long")
    held = withheld(spark.createDataFrame([(*c, f) for c, f in cells.items()], "x long, y long, fold int"), 3)

    def role(c, o, i):
        ring = {cells.get((c[0] + a, c[1] + b)) for a in (-1, 0, 1) for b in (-1, 0, 1)}
        return "outer" if cells[c] == o else "outer buffer" if o in ring else "inner" if cells[c] == i else "buffer" if i in ring else None

    pairs = [(o, i) for o in range(3) for i in (NONE, 0, 1, 2) if i != o]
    assert {tuple(r) for r in held.collect()} == {(o, i, *c, role(c, o, i)) for o, i in pairs for c in cells if role(c, o, i)}
    rows = validation(df, held, spark.createDataFrame([("i",), ("j",)], "item string"), "item", LEVELS)
    got = {(r["outer"], r["inner"], r["x"], r["y"], r["city"], r["item"]): tuple(r[c] for c in ("total", "positives", "e_all", "d_all", "e_city", "d_city")) for r in rows.collect()}
    want = {}
    for o, i in pairs:
        free = [(c, city) for c, city in lists if role(c, o, i) is None]
        for (c, city), n in lists.items():
            if role(c, o, i) == ("outer" if i == NONE else "inner"):
                for item in ("i", "j"):
                    own = [k for k in free if k[1] == city]
                    want[o, i, *c, city, item] = (n, hits[c, city, item], *[float(v) for ks in (free, own) for v in (sum(lists[k] for k in ks), sum(hits[*k, item] for k in ks))])
    assert got == want and len(want) > 100

    chosen = {(r["outer"], r["inner"], r["strength"]): (r["brier"], r["selected"]) for r in chosen_inside(rows, list(LEVELS), (1.0, 30.0)).collect()}
    for o in range(3):
        loss = {}
        for s in (1.0, 30.0):
            for i in [j for j in (NONE, 0, 1, 2) if j != o]:
                part = [v for k, v in want.items() if k[:2] == (o, i)]
                p = [(((v[3] + 1) / (v[2] + 2)) * s + v[5]) / (s + v[4]) if v[4] else (v[3] + 1) / (v[2] + 2) for v in part]
                loss[s, i] = (sum(v[1] * (1 - q) ** 2 + (v[0] - v[1]) * q * q for v, q in zip(part, p)), sum(v[0] for v in part))
        pooled = {s: sum(x for (t, i), (x, _) in loss.items() if t == s and i != NONE) / sum(n for (t, i), (_, n) in loss.items() if t == s and i != NONE) for s in (1.0, 30.0)}
        best = min(pooled, key=lambda s: (round(pooled[s], 12), s))
        for (s, i), (x, n) in loss.items():
            if i != NONE or s == best:
                assert abs(chosen[o, i, s][0] - x / n) < 1e-9 and chosen[o, i, s][1] == (s == best)
        assert (o, NONE, 1.0 + 30.0 - best) not in chosen


def test_calibrators_come_from_inner_rows_alone(spark):
    rows = [(0, i, 10, k, 100.0, 50.0, 50.0, 25.0) for i in (1, 2) for k in (6, 7, 8)] + [(0, NONE, 10, 0, 100.0, 50.0, 50.0, 25.0), (1, NONE, 4, 1, 100.0, 50.0, 0.0, 0.0)]
    schema = "outer int, inner int, total long, positives long, e_all double, d_all double, e_city double, d_city double"
    found = [(0, NONE, 10.0), (1, NONE, 10.0)]
    of = lambda r: {x["outer"]: (x["p"], x["q"]) for x in calibrated_inside(spark.createDataFrame(r, schema), list(LEVELS), spark.createDataFrame(found, "outer int, inner int, strength double")).collect()}
    got = of(rows)
    assert got[0][1] > got[0][0] + 0.05 and got[1] == (0.5, 0.5)
    other = [(*r[:3], 10, *r[4:]) if r[1] == NONE and r[0] == 0 else r for r in rows]
    assert of(other)[0] == got[0]
