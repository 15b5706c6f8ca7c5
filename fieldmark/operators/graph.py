"""Connected components by alternating large-star and small-star steps, as joins and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.sources.shared import kept


FEW = 100_000  # edges, at the most, that one task works on as they are


def _star(edges: DataFrame, large: bool, few: bool) -> DataFrame:
    """Edges (a > b). Large star: every larger neighbour of a node is tied to the least of the node and its
    neighbours; small star: the same for its smaller ones. The least is a partial aggregate joined
    back, so a hub's edges meet in no single task (a skewed join can be split). Few edges (at most FEW) stay in
    one task without any shuffle."""
    together = (lambda d: d.coalesce(1)) if few else (lambda d: d)
    if large:
        both = together(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m")).select(F.col("a").alias("u"), "m")
        out = both.filter("b > a").join(least, F.col("a") == F.col("u")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("u"), "m")
        tied = edges.join(least, F.col("a") == F.col("u"))
        out = tied.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return together(out.filter("a <> b")).distinct()


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """id, component: the least id that links reach, for every id that has a link. Ids are of an ordered
    type; self links and nulls are left out, repeated links count once; no links give no rows."""
    edges = kept(links.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b")).distinct(), "components")
    mark = lambda e: e.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
    before = mark(edges)
    while before["n"]:
        few = before["n"] <= FEW
        edges = kept(_star(_star(edges, True, few), False, few), "components")
        now = mark(edges)
        if now == before:
            break
        before = now
    roots = edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionByName(roots)
