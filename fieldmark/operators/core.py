"""Operators that the queries are made of; all take column names and return DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.functions.season import circular


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in the given order."""
    return df.withColumn("_rn", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter("_rn = 1").drop("_rn")


PART = 1_000_000  # rows, about, that one task groups


def spread(df: DataFrame, of: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys into as many parts as `of` (a plain read, as many rows as df or more) has millions of rows: what is grouped by more than
    these keys after it needs no further shuffle, and tasks don't grow with the tables."""
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(parts, -(-of.count() // PART)), *keys)


def top_k(df: DataFrame, keys: list[str], k: int, *order: Column, rank: str = "rank") -> DataFrame:
    """The first k rows of each key, ranked; Spark cuts partitions to k before the shuffle."""
    return df.withColumn(rank, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).filter(F.col(rank) <= k)


def unseen(catalogue: DataFrame, seen: DataFrame, key: str | list[str], name: str | list[str]) -> DataFrame:
    """Catalogue rows whose key and name are both unseen: two anti joins, as an OR would be a nested loop."""
    return catalogue.join(seen.select(key).distinct(), key, "left_anti").join(seen.select(name).distinct(), name, "left_anti")


def eligible(reports: DataFrame, rows: DataFrame, key: str, bad: str, reported: Column) -> DataFrame:
    """reports with saved, bad and whether they are complete: all reported rows saved, none bad."""
    counts = rows.groupBy(key).agg(F.count("*").alias("saved"), F.count_if(bad).alias("bad"))
    out = reports.join(counts, key, "left").withColumns({"saved": F.coalesce("saved", F.lit(0)), "bad": F.coalesce("bad", F.lit(0))})
    return out.withColumn("eligible", (F.col("saved") > 0) & (F.col("saved") == reported) & (F.col("bad") == 0))


def absorbing_sum(x: Column) -> Column:
    """A sum that is null when any part is null."""
    return F.when(F.count("*") == F.count(x), F.sum(x))


def kernel(spark, bandwidth: float = 2.0, reach: float = 3.5) -> DataFrame:
    """week, target, w: circular Gaussian weights between 52 weeks (52 x 52 rows at most)."""
    a, b = spark.range(1, 53).select(F.col("id").cast("int").alias("week")), spark.range(1, 53).select(F.col("id").cast("int").alias("target"))
    d = circular(F.col("week"), F.col("target"))
    return a.crossJoin(b).withColumn("d", d).filter(F.col("d") <= reach * bandwidth).select("week", "target", F.exp(-0.5 * F.pow(F.col("d") / bandwidth, 2)).alias("w"))


def smoothed(df: DataFrame, weights: DataFrame, keys: list[str], week: str, *values: str) -> DataFrame:
    """Weekly values smoothed around the circle. The kernel has a fixed size, so it is broadcast."""
    k = F.broadcast(weights.withColumnRenamed("week", week))
    return df.join(k, week).groupBy(*keys, "target").agg(*[F.sum(F.col(v) * F.col("w")).alias(v) for v in values])


def weighted_quantile(df: DataFrame, keys: list[str], value: str, weight: str, q: float) -> DataFrame:
    """The least value whose cumulated weight reaches q of the total, per key."""
    order = W.partitionBy(*keys).orderBy(value).rangeBetween(W.unboundedPreceding, 0)
    rows = df.groupBy(*keys, value).agg(F.sum(weight).alias("_w"))
    rows = rows.withColumns({"_c": F.sum("_w").over(order), "_t": F.sum("_w").over(W.partitionBy(*keys))})
    return rows.filter(F.col("_c") >= q * F.col("_t")).groupBy(*keys).agg(F.min(value).alias(value))


def beta_binomial(levels: list[tuple[str, str]], df: DataFrame, strength: float) -> Column:
    """Posterior mean down a hierarchy: at each level the prior is the level above with `strength`
    trials, less what the level itself saw; levels without trials are skipped. levels: (exposure, detections) columns, widest first."""
    e, d = levels[0]
    p = (F.col(d) + 1) / (F.col(e) + 2)
    for e, d in levels[1:]:
        p = F.when(F.coalesce(F.col(e), F.lit(0)) > 0, (p * strength + F.col(d)) / (strength + F.col(e))).otherwise(p)
    return p


def ece(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """bin, n, predicted, observed, part: the parts add up to the expected calibration error."""
    rows = df.groupBy(F.least(F.lit(bins - 1), F.floor(F.col(p) * bins)).cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    total = rows.agg(F.sum("n").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("bin", "n", "predicted", "observed", (F.col("n") / F.col("total") * F.abs(F.col("predicted") - F.col("observed"))).alias("part"))


def islands(df: DataFrame, keys: list[str], n: str) -> DataFrame:
    """keys, begin, end, size: runs of consecutive whole numbers."""
    rows = df.select(*keys, n).distinct().withColumn("_g", F.col(n) - F.row_number().over(W.partitionBy(*keys).orderBy(n)))
    return rows.groupBy(*keys, "_g").agg(F.min(n).alias("begin"), F.max(n).alias("end"), F.count("*").alias("size")).drop("_g")
