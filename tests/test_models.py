"""Parts that have no SQL: calibrators, Beta quantiles and numbering, against plain computations."""

import math

import numpy as np
from pyspark.sql import functions as F

from fieldmark.functions.beta import beta_quantile
from fieldmark.operators.calibration import beta_calibration, cross_fitted
from fieldmark.operators.numbering import numbered
from fieldmark.plans import registry


def newton(rows, ridge=1e-3):
    w, prior = np.array([1.0, 1.0, 0.0]), np.array([1.0, 1.0, 0.0])
    p, t, k = (np.array(c, float) for c in zip(*rows))
    x = np.stack([np.log(p), -np.log(1 - p), np.ones_like(p)], 1)
    for _ in range(50):
        z = 1 / (1 + np.exp(-x @ w))
        move = np.linalg.solve(x.T @ (x * np.maximum(1e-9, t * z * (1 - z))[:, None]) + ridge * np.eye(3), x.T @ (k - t * z) - ridge * (w - prior))
        w = np.clip(w + np.clip(move, -2, 2), [0.01, 0.01, -10], [10, 10, 10])
        if abs(move).max() < 1e-7:
            break
    return w


def test_calibrators_match_newton_steps(spark):
    rng = np.random.default_rng(3)
    rows = [(s, float(p), 40, int(rng.binomial(40, min(0.99, p * f)))) for s, f in (("x", 0.6), ("y", 1.3)) for p in rng.uniform(0.02, 0.7, 80)]
    df = spark.createDataFrame([*rows, ("few", 0.5, 10, 1), (None, 0.5, 10, 1), ("x", None, 10, 1), ("x", 0.5, 0, 0)], "s string, p double, t long, k long")
    got = {r["scope"]: (r["a"], r["b"], r["c"]) for r in beta_calibration(df, "s", "p", "t", "k").collect()}
    assert set(got) == {"x", "y", "few"} and got["few"] == (1, 1, 0)
    for s in "xy":
        assert np.allclose(got[s], newton([r[1:] for r in rows if r[0] == s]), atol=1e-5)
    assert beta_calibration(df.filter("false"), "s", "p", "t", "k").count() == 0


def test_cross_fit_uses_other_folds_only(spark):
    rng = np.random.default_rng(4)
    rows = [("x", i % 3, float(p), 50, int(rng.binomial(50, p / 2))) for i, p in enumerate(rng.uniform(0.1, 0.8, 60))]
    df = spark.createDataFrame([*rows, ("lone", 0, 0.25, 5, 1)], "s string, f int, p double, t long, k long")
    for r in cross_fitted(df, "s", "f", "p", "t", "k", 3).collect():
        if r["s"] == "lone":
            assert r["q"] == r["p"]
        else:
            a, b, c = newton([x[2:] for x in rows if x[1] != r["f"]])
            assert abs(r["q"] - 1 / (1 + math.exp(-(a * math.log(r["p"]) - b * math.log(1 - r["p"]) + c)))) < 1e-5


def test_beta_quantiles_against_integration(spark):
    cases = [(1.0, 1.0), (2.5, 40.0), (300.0, 2.0), (0.5, 0.5), (5000.0, 9000.0)]
    df = spark.createDataFrame([*cases, (None, 1.0), (0.0, 1.0)], "a double, b double")
    got = df.select("a", "b", beta_quantile("a", "b", F.lit(0.05)).alias("x"), beta_quantile("a", "b", F.lit(0.95)).alias("y")).collect()
    for r in got:
        if not r["a"]:
            assert r["x"] is None or math.isnan(r["x"])
            continue
        # x = sin(u)^2 takes the poles at both ends away.
        u = (np.arange(400_000) + 0.5) / 400_000 * math.pi / 2
        log = (2 * r["a"] - 1) * np.log(np.sin(u)) + (2 * r["b"] - 1) * np.log(np.cos(u))
        share = np.cumsum(np.exp(log - log.max()))
        for q, v in ((0.05, r["x"]), (0.95, r["y"])):
            at = np.searchsorted(np.sin(u) ** 2, v)
            assert abs(share[min(at, len(u) - 1)] / share[-1] - q) < 1e-3


def test_numbers_are_dense_and_in_order(spark):
    df = spark.createDataFrame([(f"k{i % 7}", i) for i in range(500)] + [(None, -1)], "g string, i int").repartition(9)
    got = sorted((r["number"], r["g"] or "", r["i"]) for r in numbered(df, "number", "g", "i").collect())
    assert [g[0] for g in got] == list(range(1, 502))
    assert [g[1:] for g in got] == sorted(g[1:] for g in got)
    assert numbered(df.filter("false"), "number", "g", "i").count() == 0


def test_model_queries_without_sql(spark):
    rows = registry.queries()["frequency_intervals"](spark, "/root/testdata/sf0.001").collect()
    assert rows and all(0 <= r["low"] < r["p"] < r["high"] <= 1 for r in rows)
    rows = registry.queries()["cross_calibration"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) == 25 and all(0 <= r["calibrated"] <= 1 for r in rows) and any(r["accepted"] for r in rows)
