"""Profiles against a plain computation over the same rounded values."""

import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fieldmark.operators.profiles import fitted, profiled, refilled, seeds


def far(a, b):
    return round(sum((x - y) ** 2 for x, y in zip(a, b)), 12)


def mean(rows):
    return [float(sum(Decimal(repr(r[i])).quantize(Decimal("1e-9")) for r in rows)) / len(rows) for i in range(len(rows[0]))]


def plain(points, count, rounds, least):
    """points: {id: values}. Rows one at a time, as the job does by aggregates."""
    dims = len(next(iter(points.values())))
    means = [mean([[p[i]] for p in points.values()])[0] for i in range(dims)]
    devs = [mean([[round((p[i] - means[i]) ** 2, 9)] for p in points.values()])[0] ** 0.5 or 1.0 for i in range(dims)]
    z = {k: [round((x - m) / s, 9) for x, m, s in zip(p, means, devs)] for k, p in points.items()}
    chosen = [min(z, key=lambda k: (far(z[k], [0] * dims), k))]
    while len(chosen) < min(count, len(z)):
        chosen.append(min((k for k in z if k not in chosen), key=lambda k: (-min(far(z[k], z[s]) for s in chosen), k)))
    centres, was = [z[s] for s in chosen], None
    for _ in range(rounds):
        now = {k: min(range(len(centres)), key=lambda c: (far(v, centres[c]), c)) for k, v in z.items()}
        near = dict(now)
        for c in range(len(centres)):
            if c not in now.values():
                open_ = [k for k in z if sum(v == now[k] for v in now.values()) > 1]
                if open_:
                    now[min(open_, key=lambda k: (-far(z[k], centres[near[k]]), k))] = c
        centres = [mean([z[k] for k in z if now[k] == c]) if c in now.values() else old for c, old in enumerate(centres)]
        if now == was:
            break
        was = now
    stay = [c for c in range(len(centres)) if sum(v == c for v in now.values()) >= least]
    out = {k: c if c in stay else min(stay, key=lambda s: (far(z[k], centres[s]), s)) for k, c in now.items()}
    return {k: stay.index(c) for k, c in out.items()}


def cloud(seed, n, spots):
    rng = random.Random(seed)
    return {i: [round(rng.gauss(3 * (i % spots), 1), 3), round(rng.gauss(-2 * (i % spots), 0.7), 3), float(i % 2)] for i in range(n)}


@pytest.mark.parametrize("seed,n,spots,count,rounds,least", [(1, 120, 3, 5, 30, 12), (2, 90, 4, 4, 2, 1), (3, 7, 2, 20, 30, 1), (4, 60, 1, 6, 30, 9)])
def test_profiles_as_computed_row_by_row(spark, seed, n, spots, count, rounds, least):
    points = cloud(seed, n, spots)
    want = plain(points, count, rounds, least)
    shuffled = [(k, *v) for k, v in points.items()]
    random.Random(seed).shuffle(shuffled)
    for parts in (1, 5):
        rows, found = fitted(spark.createDataFrame(shuffled, "id long, a double, b double, c double").repartition(parts), "id", ["a", "b", "c"], count, rounds, least)
        assert {r["id"]: r["profile"] for r in rows.collect()} == want
        assert len(found.centroids) == len(set(want.values()))


def test_empty_clusters_take_the_farthest_rows(spark):
    rows = spark.createDataFrame([(1, 0.0), (2, 1.0), (3, 3.0), (4, 10.0), (5, 3.0)], "id long, a double")
    # Nothing is nearest to 50 and 60; 4 is alone at 10 and stays; of 3 and 5, equally far from 0, the lower goes first.
    assert refilled(rows, "id", ["a"], [[0.0], [10.0], [50.0], [60.0]], {0: 4, 1: 1}) == {3: 2, 5: 3}
    assert refilled(rows.filter("id = 4"), "id", ["a"], [[0.0], [10.0]], {1: 1}) == {}
    assert refilled(rows, "id", ["a"], [[0.0], [10.0]], {0: 4, 1: 1}) == {}


def test_seeds_ties_repeats_and_nothing(spark):
    rows = spark.createDataFrame([(3, 0.0), (1, 0.0), (2, 5.0), (9, -5.0)], "id long, a double")
    assert seeds(rows, "id", ["a"], 3) == [[0.0], [5.0], [-5.0]]
    assert len(seeds(rows, "id", ["a"], 10)) == 4
    same = spark.createDataFrame([(i, 2.0, None if i == 5 else 1.0) for i in range(6)], "id long, a double, b double")
    got, found = fitted(same, "id", ["a", "b"], 3, least=1)  # equal rows: one seed has them but for those that refill the empty ones
    assert got.count() == 5 and found.deviations == [0.0, 0.0]
    with pytest.raises(ValueError, match="no rows"):
        fitted(same.filter("false"), "id", ["a", "b"], 3)
    with pytest.raises(ValueError, match="no profile has 32"):
        fitted(same, "id", ["a", "b"], 3)


def test_profiles_of_other_rows(spark):
    points = cloud(1, 120, 3)
    df = spark.createDataFrame([(k, *v) for k, v in points.items()], "id long, a double, b double, c double")
    rows, found = fitted(df, "id", ["a", "b", "c"], 3, least=5)
    want = {r["id"]: r["distance"] for r in rows.collect()}
    again = profiled(df.withColumn("more", F.lit("x")).unionByName(spark.createDataFrame([(-1, None, 0.0, 0.0, "y")], "id long, a double, b double, c double, more string")), found)
    assert again.columns == ["id", "a", "b", "c", "more", "profile", "distance"]
    got = {r["id"]: r for r in again.collect()}
    assert got[-1]["profile"] is None and got[-1]["distance"] is None
    assert all(got[k]["distance"] <= d + 1e-9 and got[k]["a"] == points[k][0] for k, d in want.items())
