"""Gradient-boosted trees over histograms, many models at once, and the gate that decides whether one may replace a simpler model."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.sources.shared import kept

BINS, ROUNDS, DEPTH = 16, 8, 3
# The ridge of leaves and the trials a leaf needs.
RIDGE, LEAST = 1.0, 20.0
RATE = 0.3
EXACT = "decimal(28,12)"


def binned(df: DataFrame, features: list[str], bins: int = BINS) -> DataFrame:
    """df with bins: the number of the equal part of each feature's range that a row falls into, -1 for null. The driver sees two numbers a feature."""
    ends = df.agg(*[f(c).cast("double").alias(f"{n}{i}") for i, c in enumerate(features) for n, f in (("low", F.min), ("high", F.max))]).first()

    def part(i: int, c: str) -> Column:
        low, high = ends[f"low{i}"], ends[f"high{i}"]
        if low is None or low == high:
            return F.when(F.col(c).isNull(), -1).otherwise(0)
        at = F.floor((F.col(c).cast("double") - low) / (high - low) * bins).cast("int")
        return F.when(F.col(c).isNull(), -1).otherwise(F.least(F.lit(bins - 1), at))

    return df.withColumn("bins", F.array(*[part(i, c) for i, c in enumerate(features)]))


def best_splits(rows: DataFrame, model: list[str], ridge: float, least: float) -> DataFrame:
    """One split for each node that gains by one: feature, bin (rows up to it go left), and the values of both sides.

    rows: model columns, _node, bins, and sums g, h, total of training trials. One partial aggregate by feature and bin; sums are decimals,
    so splits don't depend on the order of rows. Equal gains go to the lower feature, then the lower bin.
    """
    each = rows.select(*model, "_node", *[F.col(c).cast(EXACT).alias(c) for c in ("g", "h")], "total", F.posexplode("bins").alias("feature", "bin"))
    sums = each.groupBy(*model, "_node", "feature", "bin").agg(*[F.sum(c).cast("double").alias(c) for c in ("g", "h", "total")])
    node = W.partitionBy(*model, "_node", "feature")
    upto = node.orderBy("bin").rowsBetween(W.unboundedPreceding, 0)
    sums = sums.withColumns({f"{side}_{c}": F.sum(c).over(w) for c in ("g", "h", "total") for side, w in (("l", upto), ("a", node))})
    sums = sums.withColumns({f"r_{c}": F.col(f"a_{c}") - F.col(f"l_{c}") for c in ("g", "h", "total")})
    value = lambda side: F.col(f"{side}_g") / (F.col(f"{side}_h") + ridge)
    gain = F.round(sum((value(s) * F.col(f"{s}_g") * sign for s, sign in (("l", 1), ("r", 1), ("a", -1))), F.lit(0.0)), 9)
    able = sums.withColumn("gain", gain).filter((F.col("l_total") >= least) & (F.col("r_total") >= least) & (F.col("gain") > 0))
    split = F.struct("feature", "bin", value("l").alias("left"), value("r").alias("right"))
    return able.groupBy(*model, "_node").agg(F.max_by(split, F.struct("gain", -F.col("feature"), -F.col("bin"))).alias("split")).select(*model, "_node", "split.*")


def boosted(cells: DataFrame, model: list[str], rounds: int = ROUNDS, depth: int = DEPTH, rate: float = RATE, ridge: float = RIDGE, least: float = LEAST) -> DataFrame:
    """cells with q: the chance that the boosted trees of a cell's model give it.

    cells: model columns, bins (see `binned`), total and positives, training (held-out cells are scored, but add to no sum), any others. All models
    grow together, a level of a tree by one aggregate and a join with the splits found, which are few; the driver sees none of them. Each tree is
    fitted to the logistic loss by its gradient and curvature, level by level; a node that gains nothing stays a leaf. Models without training trials give 0.5.
    """
    t, k = F.when(F.col("training"), F.col("total")).otherwise(0), F.when(F.col("training"), F.col("positives")).otherwise(0)
    base = cells.groupBy(*model).agg(F.log((F.sum(k) + 0.5) / (F.sum(t) - F.sum(k) + 0.5)).alias("_f"))
    rows = kept(cells.join(base, model), "boosting")
    p = 1 / (1 + F.exp(-F.col("_f")))
    for _ in range(rounds):
        now = rows.withColumns({"_node": F.lit(1), "_add": F.lit(0.0)})
        for level in range(depth):
            trained = now.filter(F.col("training") & (F.col("_node") >= 2**level)).withColumns({"g": F.col("positives") - F.col("total") * p, "h": F.col("total") * p * (1 - p)})
            splits = kept(best_splits(trained, model, ridge, least), "splits")
            if splits.isEmpty():
                break
            met, left = now.join(splits, [*model, "_node"], "left"), F.get("bins", F.col("feature")) <= F.col("bin")
            node = F.when(F.col("bin").isNull(), F.col("_node")).otherwise(2 * F.col("_node") + F.when(left, 0).otherwise(1))
            add = F.when(F.col("bin").isNull(), F.col("_add")).when(left, F.col("left")).otherwise(F.col("right"))
            now = met.withColumns({"_node": node, "_add": add}).drop("feature", "bin", "left", "right")
        rows = kept(now.withColumn("_f", F.col("_f") + rate * F.col("_add")).drop("_node", "_add"), "boosting")
    return rows.withColumn("q", p).drop("_f")


def swapped_recall(rows: DataFrame, context: list[str], item: str, champion: str, challenger: str, actual: str, k: int) -> DataFrame:
    """context, item, delta: how the recall of the first k items changes when one item is scored by the challenger instead, the others as before.

    Only the k-th and the next item matter: one in the first k may lose its place to the next, one beyond may take that of the k-th. Equal scores go by
    item. A context without actual items has no rows; one with k items or fewer always keeps them all. Null scores count as 0.
    """
    score = lambda c: F.coalesce(F.round(F.col(c), 12), F.lit(0.0))
    by = W.partitionBy(*context)
    rows = rows.withColumns({"_p": score(champion), "_q": score(challenger)}).withColumn("_r", F.row_number().over(by.orderBy(F.desc("_p"), item)))
    entry = lambda r: F.max(F.when(F.col("_r") == r, F.struct((-F.col("_p")).alias("s"), F.col(item).alias("i"), F.col(actual).alias("y")))).over(by)
    rows = rows.withColumns({"_all": F.sum(actual).over(by), "_last": entry(k), "_next": entry(k + 1)}).filter("_all > 0")
    beats = lambda e: F.struct((-F.col("_q")).alias("s"), F.col(item).alias("i")) < F.struct(F.col(f"{e}.s").alias("s"), F.col(f"{e}.i").alias("i"))
    out = F.when((F.col("_r") <= k) & ~beats("_next"), F.col("_next.y") - F.col(actual)).when((F.col("_r") > k) & beats("_last"), F.col(actual) - F.col("_last.y"))
    return rows.select(*context, item, (F.coalesce(out, F.lit(0)) / F.col("_all")).alias("delta"))


@dataclass(frozen=True)
class Gate:
    """What a replacement must show in each fold."""

    time_folds: int = 3
    positives: int = 50
    negatives: int = 50
    improvement: float = 0.01
    ece: float = 0.01
    recall: float = 0.0


def replacements(metrics: DataFrame, item: str, gate: Gate = Gate()) -> DataFrame:
    """item, approved, failures (sorted, joined by commas): whether a challenger may replace the champion of an item.

    metrics: a row for each item and fold, with fold, kind (time, spatial or observer), valid, train_positives, train_negatives, held_positives,
    held_negatives, champion_brier, challenger_brier, champion_ece, challenger_ece, recall_delta. An invalid fold fails, and so do numbers that are
    null or not finite, a kind of fold that is missing, and too few valid folds of time.
    """
    numbers = ["train_positives", "train_negatives", "held_positives", "held_negatives", "champion_brier", "challenger_brier", "champion_ece", "challenger_ece"]
    finite = lambda c: F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double")) & (F.abs(F.col(c)) < float("inf"))
    sound = finite(numbers[0])
    for c in numbers[1:]:
        sound = sound & finite(c)
    gained = (F.col("champion_brier") - F.col("challenger_brier")) / F.greatest(F.col("champion_brier"), F.lit(1e-12))
    fails = {
        "training_positives": F.col("train_positives") < gate.positives, "validation_positives": F.col("held_positives") < gate.positives,
        "training_negatives": F.col("train_negatives") < gate.negatives, "validation_negatives": F.col("held_negatives") < gate.negatives,
        "brier": gained < gate.improvement, "ece": F.col("challenger_ece") - F.col("champion_ece") > gate.ece,
    }
    named = lambda n, when: F.when(when, F.concat_ws(".", "fold", F.lit(n)))
    valid = F.coalesce("valid", F.lit(False))
    found = [named("invalid", ~valid), named("non_finite", valid & ~sound), *[named(n, valid & sound & w) for n, w in fails.items()]]
    found.append(named("topk", ~finite("recall_delta") | (F.col("recall_delta") < gate.recall)))
    of = metrics.withColumn("_f", F.array_compact(F.array(*found))).groupBy(item).agg(
        F.flatten(F.collect_list("_f")).alias("_f"), F.count_if(valid & (F.col("kind") == "time")).alias("_t"), *[F.count_if(valid & (F.col("kind") == x)).alias(f"_{x}") for x in ("spatial", "observer")]
    )
    whole = F.array_compact(F.array(F.when(F.col("_t") < gate.time_folds, F.lit("insufficient_time_folds")), *[F.when(F.col(f"_{x}") == 0, F.lit(f"missing_{x}_holdout")) for x in ("spatial", "observer")]))
    failures = F.array_sort(F.array_distinct(F.concat("_f", whole)))
    return of.select(item, (F.size(failures) == 0).alias("approved"), F.array_join(failures, ",").alias("failures"))
