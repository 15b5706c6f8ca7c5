"""Balanced folds and panels against plain searches over all rows."""

import random

import pytest

from fieldmark.operators import folds
from fieldmark.operators.folds import PANELS, TARGETS, hashed
from fieldmark.plans import registry


def plain_loads(items, n):
    loads, out = [0] * min(n, len(items)), {}
    for load, id in sorted(items, key=lambda r: (-r[0], r[1])):
        k = min(range(len(loads)), key=lambda f: (loads[f], f))
        out[id], loads[k] = k, loads[k] + load
    return out


def test_turns_of_equal_items():
    rng = random.Random(5)
    for _ in range(500):
        loads, load, items = [rng.choice([0, 3, 7, rng.randint(0, 60)]) for _ in range(rng.randint(1, 6))], rng.randint(0, 9), rng.randint(0, 80)
        want, now = [], list(loads)
        for _ in range(items):
            k = min(range(len(now)), key=lambda f: (now[f], f))
            want.append(k)
            now[k] += load
        runs = folds.turns(loads, load, items)
        assert [of[i % len(of)] for _, length, of in runs for i in range(length)] == want
        assert loads == now and len(runs) <= len(loads)


@pytest.mark.parametrize("n,count", [(3, 400), (5, 60), (4, 2), (3, 0)])
def test_least_loaded_is_the_greedy_one(spark, n, count):
    rng = random.Random(n)
    # A third of the rows share one load; one is far larger than all.
    items = [(rng.choice([1, rng.randint(0, 12), rng.randint(0, 40)]), f"o{i:04}") for i in range(count)] + [(900, "big")] * (count > 2)
    rng.shuffle(items)
    df = spark.createDataFrame([(load or None, id, "x") for load, id in items], "load int, id string, more string")
    for parts in (1, 6):
        got = folds.least_loaded(df.repartition(parts), "id", "load", n)
        assert sorted(got.columns) == ["fold", "id", "load", "more"]
        assert {r["id"]: r["fold"] for r in got.collect()} == plain_loads(items, n)


def plain_panels(candidates, seed):
    """The search over whole lists, by recursion. candidates: (unit, city, x, y, lists, observers)."""
    by_city = {}
    for c in candidates:
        by_city.setdefault(c[1], []).append(c)
    share = {}
    for of in by_city.values():
        of.sort(key=lambda c: (c[4], c[5], c[0]))
        share |= {c[0]: 0.5 if len(of) == 1 else i / (len(of) - 1) for i, c in enumerate(of)}
    cities = sorted(by_city, key=lambda c: hashed(seed, "city-target", c))
    aim = {(c, p): TARGETS[(i + (p == PANELS[0])) % 3] for i, c in enumerate(cities) for p in PANELS}

    def free(city, taken):
        return [c for c in by_city[city] if all(abs(c[2] - t[2]) > 2 or abs(c[3] - t[3]) > 2 for t in taken)]

    def ranked(city, panel, taken):
        return sorted(free(city, taken), key=lambda c: (round(abs(share[c[0]] - aim[city, panel]), 12), hashed(seed, panel, city, c[0]), c[0]))

    def sealed(rest, taken):
        if not rest:
            return []
        city = min(rest, key=lambda c: (len(free(c, taken)), hashed(seed, "sealed-order", c)))
        for c in ranked(city, PANELS[1], taken):
            found = sealed([r for r in rest if r != city], [*taken, c])
            if found is not None:
                return [(PANELS[1], c[0]), *found]
        return None

    order = sorted(cities, key=lambda c: (len(by_city[c]), hashed(seed, "development-order", c)))

    def development(i, taken):
        if i == len(order):
            return sealed(cities, taken)
        for c in ranked(order[i], PANELS[0], taken):
            if free(order[i], [*taken, c]):
                found = development(i + 1, [*taken, c])
                if found is not None:
                    return [(PANELS[0], c[0]), *found]
        return None

    return development(0, [])


def board(seed, cities, each, side):
    rng = random.Random(seed)
    cells = rng.sample([(x, y) for x in range(side) for y in range(side)], cities * each)
    return [(f"{x}:{y}", i % cities, x, y, rng.randint(1, 9), rng.randint(1, 3)) for i, (x, y) in enumerate(cells)]


SHAPE = "unit string, city long, x long, y long, lists long, observers long"


@pytest.mark.parametrize("seed,cities,each,side,shortlist", [(1, 5, 8, 24, 32), (2, 5, 8, 24, 1), (3, 4, 5, 11, 2), (4, 3, 4, 9, 1), (5, 6, 3, 15, 32), (6, 4, 6, 8, 3), (7, 4, 6, 7, 2)])
def test_panels_as_by_the_whole_search(spark, seed, cities, each, side, shortlist):
    """Roomy and crowded boards, some with no answer, shortlists that are too short at first."""
    candidates = board(seed, cities, each, side)
    want = plain_panels(candidates, "s")
    df = spark.createDataFrame(candidates[::-1], SHAPE)
    if want is None:
        with pytest.raises(ValueError, match="no panels"):
            folds.split_panels(df, "s", shortlist)
        return
    got = folds.split_panels(df, "s", shortlist)
    assert sorted((r["panel"], r["unit"]) for r in got.collect()) == sorted(want)
    assert got.columns and set(SHAPE.replace(" long", "").replace(" string", "").split(", ")) < set(got.columns)


def test_panels_without_cities_or_with_one_candidate(spark):
    empty = spark.createDataFrame([], SHAPE)
    assert folds.split_panels(empty, "s").count() == 0
    with pytest.raises(ValueError, match="fewer than two"):
        folds.split_panels(spark.createDataFrame([("0:0", 1, 0, 0, 1, 1)], SHAPE), "s")
    with pytest.raises(ValueError, match="states"):
        folds.split_panels(spark.createDataFrame(board(1, 5, 8, 24), SHAPE), "s", states=3)


def test_registered_panels_are_apart_and_balanced(spark):
    rows = registry.queries()["split_panel_anchors"](spark, "/root/testdata/sf0.01").collect()
    places = [tuple(map(int, r["unit"].split(":"))) for r in rows]
    assert len(rows) >= 40 and all(abs(a[0] - b[0]) > 2 or abs(a[1] - b[1]) > 2 for i, a in enumerate(places) for b in places[:i])
    for panel in PANELS:
        of = [r for r in rows if r["panel"] == panel]
        sizes = [sum(r["fold"] == f for r in of) for f in range(1, 6)]
        assert len({r["city"] for r in of}) == len(of) and max(sizes) - min(sizes) <= 1
        sums, want = [(0, 0, 0)] * 5, {}
        for r in sorted(of, key=lambda r: (-r["lists"], -r["observers"], hashed("panels-1", panel, "fold-anchor", r["unit"]))):
            k = min(range(5), key=lambda f: (*sums[f], hashed("panels-1", panel, "fold", f + 1, r["unit"])))
            want[r["unit"]], sums[k] = k + 1, (sums[k][0] + 1, sums[k][1] + r["lists"], sums[k][2] + r["observers"])
        assert {r["unit"]: r["fold"] for r in of} == want
