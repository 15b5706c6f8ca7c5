"""Joins of names that hold one another."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 3


def grams(x: Column, size: int) -> Column:
    """The different parts of that many characters; none of a shorter text."""
    parts = F.transform(F.sequence(F.lit(1), F.length(x) - size + 1), lambda i: x.substr(i, F.lit(size)))
    return F.when(F.length(x) >= size, F.array_distinct(parts)).otherwise(F.array())


def containing(short: DataFrame, s: str, long: DataFrame, l: str, size: int = GRAM) -> DataFrame:  # noqa: E741
    """s, l: each pair of different names of both sides where l holds s; an empty or null s is held by none.

    A short name asks for one of its parts only, the one that the fewest long names have (a name shorter than a part asks for itself), so pairs
    are made by an equal part and then tested; the work follows how rare the rarest part of a name is, not the product of both sides.
    """
    short, long = short.select(s).distinct(), long.select(l).distinct()
    offered = long.select(l, F.explode(F.concat(*[grams(F.col(l), n) for n in range(1, size + 1)])).alias("_gram"))
    counts = offered.groupBy("_gram").agg(F.count("*").alias("_n"))
    own = F.coalesce(*[F.when(F.length(s) >= n, grams(F.col(s), n)) for n in range(size, 0, -1)])
    asked = short.select(s, F.explode(own).alias("_gram")).join(counts, "_gram", "left").fillna(0, ["_n"])
    asked = asked.groupBy(s).agg(F.min_by("_gram", F.struct("_n", "_gram")).alias("_gram"))
    return asked.join(offered, "_gram").filter(F.contains(F.col(l), F.col(s))).select(s, l)
