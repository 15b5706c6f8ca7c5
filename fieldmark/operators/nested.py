"""Hold-outs within hold-outs: what each pair of an outer and an inner fold withholds, sums of what is left, and settings chosen inside."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldmark.operators.calibration import beta_calibration, calibrated
from fieldmark.operators.places import ring
from fieldmark.operators.priors import posterior
from fieldmark.sources.shared import kept

#: The inner fold of rows that are about the outer fold alone.
NONE = -1
PAIR = ["outer", "inner"]


def withheld(cells: DataFrame, folds: int) -> DataFrame:
    """outer, inner, x, y, role of each cell that a pair of folds keeps from training; all others train.

    cells: x, y and fold (0..folds-1, or null for cells that are never held out), a row each. A cell of the outer fold is `outer`, one in the ring of
    such a cell `outer buffer`; of the others, one of the inner fold is `inner`, one in its ring `buffer`. Inner NONE withholds for the outer fold
    alone. A cell goes once to its own ring and then once to each pair that it matters for, so the work grows with the cells held out.
    """
    near = ring(cells.filter("fold IS NOT NULL").select("x", "y", "fold")).groupBy("x", "y").agg(F.collect_set("fold").alias("near"))
    pairs = F.array(*[F.struct(F.lit(o).alias("outer"), F.lit(i).alias("inner")) for o in range(folds) for i in (NONE, *range(folds)) if i != o])
    rows = cells.join(near, ["x", "y"]).select("x", "y", "fold", "near", F.inline(pairs))
    by_outer, by_inner = F.array_contains("near", F.col("outer")), F.array_contains("near", F.col("inner"))
    role = F.when(F.col("fold") == F.col("outer"), "outer").when(by_outer, "outer buffer").when(F.col("fold") == F.col("inner"), "inner").when(by_inner, "buffer")
    return rows.select(*PAIR, "x", "y", role.alias("role")).filter("role IS NOT NULL")


def validation(counts: DataFrame, held: DataFrame, items: DataFrame, item: str, levels: dict[str, list[str]]) -> DataFrame:
    """outer, inner, place columns, item, total, positives of each validated cell, and e_<level>, d_<level>: sums of its training rows by level.

    counts: x, y, the columns of all levels, item (null: total holds all lists of the place) and n. levels: from the widest, each with its columns.
    Sums are made once over all rows; those of the withheld cells, made for each pair, are taken from them, so nothing is summed again for each pair.
    Each validated place is asked for every row of items.
    """
    place = sorted({c for keys in levels.values() for c in keys})
    taken = kept(counts.join(held, ["x", "y"]), "withheld-counts")
    seen = F.col(item).isNotNull()
    asked = taken.filter(F.col("role") == F.when(F.col("inner") == NONE, "outer").otherwise("inner"))
    key = [*PAIR, "x", "y", *place]
    rows = asked.filter(~seen).groupBy(*key).agg(F.sum("n").alias("total")).crossJoin(F.broadcast(items))
    rows = kept(rows.join(asked.filter(seen).groupBy(*key, item).agg(F.sum("n").alias("positives")), [*key, item], "left").fillna(0, ["positives"]), "validated")
    for level, keys in levels.items():
        for name, of, own in ((f"e_{level}", ~seen, keys), (f"d_{level}", seen, [*keys, item])):
            every, part = counts.filter(of).groupBy(*own).agg(F.sum("n").alias("_all")), taken.filter(of).groupBy(*PAIR, *own).agg(F.sum("n").alias("_held"))
            rows = rows.join(every, own, "left") if own else rows.crossJoin(F.broadcast(every))
            rows = rows.join(part, [*PAIR, *own], "left").fillna(0, ["_all", "_held"]).withColumn(name, (F.col("_all") - F.col("_held")).cast("double")).drop("_all", "_held")
    return kept(rows, "validated")


def brier_loss(p: Column) -> Column:
    return F.sum(F.col("positives") * F.pow(1 - p, 2.0) + (F.col("total") - F.col("positives")) * F.pow(p, 2.0))


def chosen_inside(rows: DataFrame, levels: list[str], strengths: tuple[float, ...]) -> DataFrame:
    """outer, inner, strength, total, brier, selected: each prior strength in each inner fold, and the outer fold (inner NONE) under the strength that its own inner
    folds chose together. Rows as `validation` gives them; equal scores go to the lower strength. One aggregate tries all strengths side by side."""
    at = lambda s: posterior(levels, [s] * (len(levels) - 1))
    losses = rows.filter(F.col("inner") != NONE).groupBy(*PAIR).agg(F.sum("total").alias("total"), F.array(*[F.struct(F.lit(float(s)).alias("strength"), brier_loss(at(F.lit(float(s)))).alias("loss")) for s in strengths]).alias("tried"))
    losses = kept(losses.select(*PAIR, "total", F.inline("tried")), "inner-losses")
    pooled = losses.groupBy("outer", "strength").agg(F.round(F.sum("loss") / F.sum("total"), 12).alias("brier"))
    best = kept(pooled.groupBy("outer").agg(F.min_by("strength", F.struct("brier", "strength")).alias("best")), "inner-choices")
    inside = losses.join(best, "outer").select(*PAIR, "strength", "total", (F.col("loss") / F.col("total")).alias("brier"), (F.col("strength") == F.col("best")).alias("selected"))
    outside = rows.filter(F.col("inner") == NONE).join(best, "outer").groupBy(*PAIR, "best").agg(F.sum("total").alias("total"), brier_loss(at(F.col("best"))).alias("loss"))
    return inside.unionByName(outside.select(*PAIR, F.col("best").alias("strength"), "total", (F.col("loss") / F.col("total")).alias("brier"), F.lit(True).alias("selected")))


def calibrated_inside(rows: DataFrame, levels: list[str], found: DataFrame) -> DataFrame:
    """rows of outer folds with p and q: p by the strength that `chosen_inside` found, q calibrated by what the inner folds of the same outer fold
    say about their own chances, so that no outer row touches its calibrator. An outer fold without inner rows keeps p."""
    best = found.filter(F.col("inner") == NONE).select("outer", "strength")
    scored = kept(rows.join(best, "outer").withColumn("p", posterior(levels, [F.col("strength")] * (len(levels) - 1))), "nested-scores")
    fits = beta_calibration(scored.filter(F.col("inner") != NONE), "outer", "p", "total", "positives").withColumnRenamed("scope", "outer")
    out = scored.filter(F.col("inner") == NONE).join(fits, "outer", "left")
    q = F.when(F.col("a").isNull(), F.col("p")).otherwise(calibrated(F.col("p"), F.col("a"), F.col("b"), F.col("c")))
    return out.withColumn("q", q)
