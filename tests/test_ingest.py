"""How aliases settle, and the limits of probabilities."""

import math

from pyspark.sql import functions as F

from fieldmark.operators.calibration import calibrated
from fieldmark.sources.ingest import fields, text


def test_first_alias_that_is_not_empty_is_taken_and_then_trimmed(spark):
    cases = {'{"a": "", "b": " x "}': "x", '{"a": "  ", "b": "x"}': "", '{"b": "\\u3000x\\t", "c": "y"}': "x", '{"a": null, "c": 7}': "7", "{}": "", "broken": "", None: ""}
    df = spark.createDataFrame([(k,) for k in cases], "raw string")
    got = df.select("raw", text(fields(F.col("raw")), ("a", "b", "c")).alias("t")).collect()
    assert {r["raw"]: r["t"] for r in got} == cases


def test_calibrators_are_applied_within_a_billionth(spark):
    p = spark.createDataFrame([(0.0,), (1e-9,), (5e-9,), (0.3,), (1.0,)], "p double")
    got = [r[0] for r in p.select(calibrated(F.col("p"), F.lit(1.0), F.lit(1.0), F.lit(0.0))).collect()]
    assert all(math.isclose(a, b, rel_tol=1e-6) for a, b in zip(got, [1e-9, 1e-9, 5e-9, 0.3, 1 - 1e-9]))
