"""Families of calibrators against plain Newton steps."""

import math
import random

from pyspark.sql import functions as F

from fieldmark.operators.calibration import SHRINKAGES, beta_calibration, calibrator_scope, chosen_families, one_parameter


def newton(points, kind, ridge=0.1):
    if len(points) < 3:
        return None
    start = v = 0.0 if kind == "intercept" else 1.0
    low, high, most = (-12, 12, 2) if kind == "intercept" else (0.05, 20, 1)
    for _ in range(80):
        g, h = -ridge * (v - start), ridge
        for p, t, k in points:
            x = math.log(p) - math.log(1 - p)
            z = 1 / (1 + math.exp(-(x + v if kind == "intercept" else x * v)))
            w = 1 if kind == "intercept" else x
            g, h = g + w * (k - t * z), h + max(1e-12, t * z * (1 - z) * w * w)
        step = max(-most, min(most, g / h))
        v = max(low, min(high, v + step))
        if abs(step) < 1e-8:
            break
    return (1.0, 1.0, v) if kind == "intercept" else (v, v, 0.0)


def made(seed=3):
    rng, rows = random.Random(seed), []
    for scope, shift, scale in (("high", 0.9, 1.0), ("flat", 0.0, 0.5), ("true", 0.0, 1.0)):
        for i in range(90):
            p, t = rng.uniform(0.05, 0.95), rng.randint(5, 40)
            q = 1 / (1 + math.exp(-((math.log(p) - math.log(1 - p)) * scale + shift)))
            rows.append((scope, i % 3, p, t, sum(rng.random() < q for _ in range(t))))
    return rows + [("few", 0, 0.4, 10, 3), ("few", 1, 0.6, 10, 9)]


SCHEMA = "scope string, fold int, p double, t int, k int"


def test_intercept_and_temperature_as_by_plain_newton(spark):
    rows = made()
    df = spark.createDataFrame([*rows, ("high", 0, None, 5, 1), ("high", 0, 0.5, 0, 0), ("high", 0, 0.5, 2, 3), (None, 0, 0.5, 5, 1)], SCHEMA)
    got = {(r["scope"], r["family"]): (r["a"], r["b"], r["c"]) for r in one_parameter(df, "scope", "p", "t", "k").collect()}
    assert {s for s, _ in got} == {"high", "flat", "true"}
    for (scope, family), fit in got.items():
        want = newton([r[2:] for r in rows if r[0] == scope], family)
        assert all(abs(x - y) < 1e-7 for x, y in zip(fit, want))
    assert got["high", "intercept"][2] > 0.7 and got["flat", "temperature"][0] < 0.7
    assert one_parameter(df.filter("false"), "scope", "p", "t", "k").count() == 0


def test_families_are_chosen_across_folds(spark):
    rows = made()
    df = spark.createDataFrame(rows, SCHEMA)
    parts = [(f"{s}/{held}", *r[1:]) for s in ("high", "flat", "true") for held in (-1, 0, 1, 2) for r in rows if r[0] == s and r[1] != held]
    beta = {r["scope"]: (r["a"], r["b"], r["c"]) for r in beta_calibration(spark.createDataFrame(parts, SCHEMA), "scope", "p", "t", "k").collect()}
    got = {(r["scope"], r["family"], r["shrinkage"]): r for r in chosen_families(df, "scope", "fold", "p", "t", "k", 3).collect()}
    for scope in ("high", "flat", "true"):
        mine, scores = [r[1:] for r in rows if r[0] == scope], {}
        for turn, family in enumerate(("identity", "intercept", "temperature", "beta")):
            for s in SHRINKAGES if turn else (0.0,):
                loss = 0
                for held in (-1, 0, 1, 2):
                    points = [r[1:] for r in mine if r[0] != held]
                    a, b, c = (1.0, 1.0, 0.0) if not turn else beta[f"{scope}/{held}"] if family == "beta" else newton(points, family)
                    a, b, c = 1 + s * (a - 1), 1 + s * (b - 1), s * c
                    if held < 0:
                        r = got[scope, family, s]
                        assert max(abs(r["a"] - a), abs(r["b"] - b), abs(r["c"] - c)) < 1e-6
                    for _, p, t, k in (r for r in mine if r[0] == held):
                        q = 1 / (1 + math.exp(-(a * math.log(p) - b * math.log(1 - p) + c)))
                        loss += k * (1 - q) ** 2 + (t - k) * q * q
                scores[turn, s] = loss / sum(r[2] for r in mine)
                assert abs(got[scope, family, s]["brier"] - scores[turn, s]) < 1e-7
        best = min(scores, key=lambda x: (round(scores[x], 12), *x))
        assert [(f, s) for (c, f, s), r in got.items() if c == scope and r["selected"]] == [(("identity", "intercept", "temperature", "beta")[best[0]], best[1])]
    assert [f for (c, f, _), r in got.items() if c == "few" and r["selected"]] == ["identity"]
    assert len({f for (c, f, _), r in got.items() if r["selected"]}) >= 2


def test_scopes_by_support(spark):
    rows = spark.createDataFrame([(n,) for n in (0, 29, 30, 59, 60, 119, 120, 199, 200)], "n int").select("n", calibrator_scope(F.lit("x"), F.col("n")).alias("s"))
    want = [None, None, "positive_30_59", "positive_30_59", "positive_60_119", "positive_60_119", "positive_120_199", "positive_120_199"]
    assert [r["s"] for r in rows.orderBy("n").collect()] == [w and f"group:{w}" for w in want] + ["species:x"]
