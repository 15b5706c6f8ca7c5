"""Boosted trees, swapped recall and the gate against plain computations."""

import math
import random

from fieldmark.operators.boosting import Gate, binned, boosted, replacements, swapped_recall


def plain_boosting(rows, rounds, depth, rate, ridge, least):
    """rows: (bins, total, positives, training); the chance of each."""
    t, k = (sum(r[i] for r in rows if r[3]) for i in (1, 2))
    f = [math.log((k + 0.5) / (t - k + 0.5))] * len(rows)
    for _ in range(rounds):
        nodes, add = {1: list(range(len(rows)))}, [0.0] * len(rows)
        for _ in range(depth):
            below = {}
            for node, members in nodes.items():
                p = {i: 1 / (1 + math.exp(-f[i])) for i in members}
                sums = lambda ids: (sum(rows[i][2] - rows[i][1] * p[i] for i in ids), sum(rows[i][1] * p[i] * (1 - p[i]) for i in ids), sum(rows[i][1] for i in ids))
                trained, found = [i for i in members if rows[i][3]], []
                for feature in range(len(rows[0][0])):
                    for b in {rows[i][0][feature] for i in trained}:
                        (lg, lh, lt), (rg, rh, rt) = sums([i for i in trained if rows[i][0][feature] <= b]), sums([i for i in trained if rows[i][0][feature] > b])
                        gain = round(lg**2 / (lh + ridge) + rg**2 / (rh + ridge) - (lg + rg) ** 2 / (lh + rh + ridge), 9)
                        if gain > 0 and lt >= least and rt >= least:
                            found.append((-gain, feature, b, lg / (lh + ridge), rg / (rh + ridge)))
                if found:
                    _, feature, b, left, right = min(found)
                    for i in members:
                        side = rows[i][0][feature] > b
                        add[i] = right if side else left
                        below.setdefault(2 * node + side, []).append(i)
            nodes = below
        f = [x + rate * a for x, a in zip(f, add)]
    return [1 / (1 + math.exp(-x)) for x in f]


def test_trees_as_by_plain_boosting(spark):
    rng, rows = random.Random(5), []
    for model in ("a", "b"):
        for i in range(150):
            bins = [rng.randint(-1, 7), rng.randint(0, 3), rng.randint(0, 7)]
            total = rng.randint(1, 9)
            rate = (0.8 if bins[0] > 3 else 0.2) if model == "a" else (0.7 if bins[1] + bins[2] > 5 else 0.4)
            rows.append((model, i, bins, total, sum(rng.random() < rate for _ in range(total)), i % 4 != 0))
    rows += [("held", 0, [1, 1, 1], 5, 2, False), ("flat", 0, [1, 1, 1], 30, 12, True)]
    df = spark.createDataFrame(rows, "model string, id int, bins array<int>, total int, positives int, training boolean").repartition(5)
    got = {(r["model"], r["id"]): r["q"] for r in boosted(df, ["model"], 3, 3, 0.3, 1.0, 20.0).collect()}
    for model in ("a", "b"):
        mine = [r for r in rows if r[0] == model]
        want = plain_boosting([r[2:] for r in mine], 3, 3, 0.3, 1.0, 20.0)
        assert all(abs(got[model, r[1]] - w) < 1e-9 for r, w in zip(mine, want)) and len(set(want)) > 4
    assert got["held", 0] == 0.5 and abs(got["flat", 0] - 12.5 / 31) < 1e-12
    assert boosted(df.filter("false"), ["model"], 1).count() == 0


def test_bins_of_ranges_nulls_and_constants(spark):
    df = spark.createDataFrame([(0.0, 3), (1.0, 3), (0.5, None), (None, 3)], "x double, y int")
    assert sorted(map(tuple, (r["bins"] for r in binned(df, ["x", "y"], 4).collect()))) == [(-1, 0), (0, 0), (2, -1), (3, 0)]
    assert binned(df.filter("false"), ["x"]).count() == 0


def test_swapped_recall_as_by_sorting(spark):
    rng, rows, k = random.Random(8), [], 3
    for c in range(60):
        rows += [(c, f"i{i}", rng.randint(0, 4) / 4, rng.randint(0, 4) / 4, rng.randint(0, 1) if c else 0) for i in range(rng.randint(1, 7))]
    want = {}
    for c in range(60):
        mine = [r[1:] for r in rows if r[0] == c]
        actual = {r[0] for r in mine if r[3]}
        for item, _, q, _ in mine if actual else []:
            first = lambda scores: {i for i, _ in sorted(scores, key=lambda x: (-x[1], x[0]))[:k]}
            before, after = first([(r[0], r[1]) for r in mine]), first([(r[0], q if r[0] == item else r[1]) for r in mine])
            want[c, item] = round((len(after & actual) - len(before & actual)) / len(actual), 9)
    got = swapped_recall(spark.createDataFrame(rows, "c int, item string, p double, q double, y int"), ["c"], "item", "p", "q", "y", k)
    assert {(r["c"], r["item"]): round(r["delta"], 9) for r in got.collect()} == want and len({*want.values()}) > 3


def test_gate_names_what_fails(spark):
    good = dict(valid=True, train_positives=80, train_negatives=80, held_positives=60, held_negatives=60, champion_brier=0.2, challenger_brier=0.19, champion_ece=0.02, challenger_ece=0.03, recall_delta=0.0)
    folds = [("t1", "time"), ("t2", "time"), ("t3", "time"), ("s", "spatial"), ("o", "observer")]
    rows = [("good", *f, good) for f in folds]
    rows += [("few", *f, good) for f in folds[1:4]]
    bad = [{"valid": False, "recall_delta": None}, {"champion_ece": None}, {"held_positives": 49, "recall_delta": -0.1}, {"challenger_brier": 0.199}, {"challenger_ece": 0.031, "train_negatives": 0}]
    rows += [("bad", *f, {**good, **b}) for f, b in zip(folds, bad)]
    df = spark.createDataFrame([(i, f, kind, *m.values()) for i, f, kind, m in rows], "item string, fold string, kind string, valid boolean, train_positives long, train_negatives long, held_positives long, held_negatives long, champion_brier double, challenger_brier double, champion_ece double, challenger_ece double, recall_delta double")
    got = {r["item"]: (r["approved"], r["failures"]) for r in replacements(df, "item", Gate(ece=0.0105)).collect()}
    assert got["good"] == (True, "") and got["few"] == (False, "insufficient_time_folds,missing_observer_holdout")
    assert got["bad"] == (False, ",".join(sorted(["insufficient_time_folds", "t1.invalid", "t1.topk", "t2.non_finite", "t3.validation_positives", "t3.topk", "s.brier", "o.ece", "o.training_negatives"])))
