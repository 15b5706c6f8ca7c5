"""Registered queries of the boosted challenger: what it scores in each fold, and which groups of taxa it may take over."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldmark.functions.season import season_day
from fieldmark.operators.boosting import Gate, binned, boosted, replacements, swapped_recall
from fieldmark.operators.places import cell, split_by_cell
from fieldmark.plans.checklist_queries import query
from fieldmark.plans.model_queries import PRIOR
from fieldmark.sources.shared import kept
from fieldmark.sources.tables import checklists, observations, observers, taxa

FEATURES = ["s", "c", "lon", "lat", "year"]
#: Groups of taxa that are challenged (the first letters of a family), years held out in turn, and the first ranks that recall is about.
TARGETS, YEARS, FIRST = tuple(f"Brand#{i}" for i in range(1, 6)), (1998, 1999, 2000), 2
FOLD = ["fold", "kind"]


def contexts(spark, d) -> DataFrame:
    """report_id, observer, city, bins and the cell of each list, with found: the groups on it."""
    groups = taxa(spark, d).select("taxon", F.substring("family", 1, len(TARGETS[0])).alias("target"))
    found = observations(spark, d).join(groups, "taxon").groupBy("report_id").agg(F.sort_array(F.collect_set("target")).alias("found"))
    turn = 2 * F.pi() * season_day(F.col("day")) / 365
    lists = checklists(spark, d).join(observers(spark, d), "observer").withColumns({"s": F.sin(turn), "c": F.cos(turn), "year": F.year("day")})
    rows = binned(lists, FEATURES).select("report_id", "observer", "city", "year", "bins", *cell()).join(found, "report_id", "left")
    return kept(rows.withColumn("found", F.coalesce("found", F.array().cast("array<string>"))), "contexts")


def folds(lists: DataFrame) -> DataFrame:
    """lists once for each fold that they train or are held out in: rolling years, cells less the ring of those held out, observers."""
    hashed = lambda *c: F.substring(F.sha2(F.concat_ws(":", *c), 256), 1, 1).isin("0", "1", "2")
    roles = split_by_cell(lists.select("x", "y").distinct(), hashed("x", "y"))
    rows = lists.join(roles, ["x", "y"])
    fold = lambda name, kind, training: F.struct(F.lit(name).alias("fold"), F.lit(kind).alias("kind"), training.alias("training"))
    each = [fold(f"time_{y}", "time", F.when(F.col("year") < y, True).when(F.col("year") == y, False)) for y in YEARS]
    each.append(fold("cells", "spatial", F.when(F.col("role") == "training", True).when(F.col("role") == "validation", False)))
    each.append(fold("observers", "observer", ~hashed(F.col("observer").cast("string"))))
    return rows.select("report_id", "observer", "city", "bins", "found", F.inline(F.array(*each))).filter("training IS NOT NULL")


def scored(lists: DataFrame) -> DataFrame:
    """fold, kind, target, city, bins, training, total, positives, with the chances of the champion (p: the city's share, held to the share of all) and of the
    challenger (q). Lists alike in city and bins are counted once, so each further step works on counts; the trees don't see the city, so they grow on counts by bins."""
    target = F.explode(F.array(*map(F.lit, TARGETS))).alias("target")
    counted = lists.groupBy(*FOLD, "city", "bins", "training", "found").agg(F.count("*").alias("n")).select("*", target)
    cells = counted.groupBy(*FOLD, "target", "city", "bins", "training").agg(F.sum("n").alias("total"), F.sum(F.when(F.array_contains("found", F.col("target")), F.col("n")).otherwise(0)).alias("positives"))
    cells = kept(cells, "challenger-cells")
    city = cells.filter("training").groupBy("fold", "target", "city").agg(F.sum("total").alias("e"), F.sum("positives").alias("d"))
    wide = city.groupBy("fold", "target").agg(((F.sum("d") + 1) / (F.sum("e") + 2)).alias("all"))
    of = lambda c: F.sum(F.when(F.col("training"), F.col(c)).otherwise(0)).alias(c)
    grown = cells.groupBy("fold", "target", "bins").agg(of("total"), of("positives")).withColumn("training", F.col("total") > 0)
    chance = boosted(grown, ["fold", "target"]).select("fold", "target", "bins", "q")
    rows = cells.join(chance, ["fold", "target", "bins"]).join(wide, ["fold", "target"], "left").join(city, ["fold", "target", "city"], "left").fillna(0.5, ["all"]).fillna(0, ["e", "d"])
    return kept(rows.withColumn("p", (F.col("all") * PRIOR + F.col("d")) / (PRIOR + F.col("e"))).drop("all", "e", "d"), "challenger-scores")


def metrics(spark, d) -> DataFrame:
    lists = kept(folds(contexts(spark, d)), "challenger-folds")
    rows = scored(lists)
    held, key = rows.filter("NOT training"), [*FOLD, "target"]
    parts = []
    for who, p in (("champion", "p"), ("challenger", "q")):
        x = F.col(p)
        bins = held.groupBy(*key, F.least(F.lit(9), F.floor(x * 10)).alias("bin")).agg(
            F.sum("total").alias("t"), F.abs(F.sum(F.col("total") * x) - F.sum("positives")).alias("off"), F.sum(F.col("positives") * F.pow(1 - x, 2.0) + (F.col("total") - F.col("positives")) * F.pow(x, 2.0)).alias("loss")
        )
        parts.append(bins.groupBy(*key).agg((F.sum("loss") / F.sum("t")).alias(f"{who}_brier"), (F.sum("off") / F.sum("t")).alias(f"{who}_ece")))
    # Support counts observers, as one observer's lists don't speak independently of each other.
    by_observer = lists.groupBy(*FOLD, "training", "observer").agg(F.count("*").alias("n"), *[F.count_if(F.array_contains("found", t)).alias(f"n{i}") for i, t in enumerate(TARGETS)])
    each = by_observer.select(*FOLD, "training", F.inline(F.array(*[F.struct(F.lit(t).alias("target"), (F.col(f"n{i}") > 0).alias("with"), (F.col(f"n{i}") < F.col("n")).alias("without")) for i, t in enumerate(TARGETS)])))
    of = lambda c, training: F.count_if(F.col(c) & (F.col("training") == training))
    support = each.groupBy(*key).agg(of("with", True).alias("train_positives"), of("without", True).alias("train_negatives"), of("with", False).alias("held_positives"), of("without", False).alias("held_negatives"))
    # Lists alike in city, bins and groups rank alike, so each kind is ranked once and counts n times.
    alike = lists.filter("NOT training").groupBy("fold", "city", "bins", "found").agg(F.count("*").alias("n"))
    tested = alike.select("*", F.explode(F.array(*map(F.lit, TARGETS))).alias("target"))
    ranked = tested.join(held.select("fold", "target", "city", "bins", "p", "q"), ["fold", "target", "city", "bins"]).withColumn("y", F.array_contains("found", F.col("target")).cast("int"))
    recall = swapped_recall(ranked, ["fold", "city", "bins", "found", "n"], "target", "p", "q", "y", FIRST).groupBy("fold", "target").agg((F.sum(F.col("delta") * F.col("n")) / F.sum("n")).alias("recall_delta"))
    out = reduce(lambda a, b: a.join(b, key, "left"), [support, *parts]).join(recall, ["fold", "target"], "left")
    both = reduce(lambda a, b: a & b, [F.col(c) > 0 for c in ("train_positives", "train_negatives", "held_positives", "held_negatives")])
    return out.withColumn("valid", both)


@query()
def challenger_metrics(spark, d):
    """Each group's boosted challenger against the city's share, by rolling years, cells with a buffer, and observers: Brier scores, calibration errors, independent
    support on both sides, and what recall of the first two groups gains when only this group's score is swapped."""
    rounded = ["champion_brier", "challenger_brier", "champion_ece", "challenger_ece", "recall_delta"]
    return metrics(spark, d).withColumns({c: F.round(c, 6) for c in rounded})


@query()
def challenger_gate(spark, d):
    """Which groups the challenger may take over, or all that speaks against it."""
    return replacements(metrics(spark, d), "target", Gate(positives=10, negatives=10, recall=-0.001))
