"""Occurrence events: detections of a taxon that chain through days and neighbouring cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.operators.graph import components
from fieldmark.operators.places import ring
from fieldmark.sources.shared import kept

# Days and rings that chain, the share of a dominant event, the most that an event may weigh.
GAP_DAYS, REACH, DOMINANT, EVENT_CAP = 3, 1, 0.8, 1.0
REASONS = {(True, True): "event_dominated_and_single_support_year", (True, False): "event_dominated", (False, True): "single_support_year"}


def independent(detections: DataFrame) -> DataFrame:
    """One row for each taxon, observer, day and cell (x, y): raw (detections), report (the least), weight (their sum).

    A detection without an observer is an observer of its own report.
    """
    who = F.coalesce(F.col("observer").cast("string"), F.concat(F.lit("report:"), F.col("report_id").cast("string")))
    rows = detections.withColumn("observer", who).groupBy("taxon", "observer", "day", "x", "y")
    return rows.agg(F.count("*").alias("raw"), F.min("report_id").alias("report"), F.sum("weight").alias("weight"))


def clustered(evidence: DataFrame, gap: int = GAP_DAYS, reach: int = REACH) -> DataFrame:
    """evidence with event, a name for each group of its taxon's rows that chain, and whether it has several spans (chained): a step leads at most `gap` days on and `reach` cells aside.

    Days of one taxon and cell that chain are one span (its first day: since), however many observers it has. Spans with no other span of their taxon
    within `gap` days are events by themselves; only the others are handed to the cells around. Spans of one cell are more than `gap` days
    apart, so of those that began no later only the last can touch a span from aside: each span makes one link at most in each cell around it.
    """
    to_here = lambda w: w.rowsBetween(W.unboundedPreceding, 0)
    apart = lambda after, before: F.coalesce(F.datediff(after, before) > gap, F.lit(True))
    of = W.partitionBy("taxon", "x", "y").orderBy("day")
    rows = evidence.withColumn("since", F.when(apart("day", F.lag("day").over(of)), F.col("day"))).withColumn("since", F.max("since").over(to_here(of)))
    rows = kept(rows, "event-spans")
    spans = rows.groupBy("taxon", "x", "y", "since").agg(F.max("day").alias("till"))
    by = W.partitionBy("taxon").orderBy("since", "x", "y")
    ended = F.max("till").over(to_here(by))
    spans = spans.withColumns({"before": F.max("till").over(by.rowsBetween(W.unboundedPreceding, -1)), "ended": ended, "next": F.lead("since").over(by)})
    near = spans.filter(~apart("since", "before") | ~apart("next", "ended")).select("taxon", "x", "y", "since", "till", F.monotonically_increasing_id().alias("id"))
    near = kept(near, "event-near")
    met = ring(near.withColumns({"ox": F.col("x"), "oy": F.col("y")}), reach).withColumn("own", (F.col("x") == F.col("ox")) & (F.col("y") == F.col("oy")))
    last = F.last(F.when(F.col("own"), F.struct("id", "till")), ignorenulls=True).over(to_here(W.partitionBy("taxon", "x", "y").orderBy("since", F.desc("own"))))
    links = met.withColumn("last", last).filter(~F.col("own") & ~apart("since", "last.till")).select("id", F.col("last.id").alias("other"))
    named = components(links, "id", "other").join(near.drop("till"), "id")
    name = F.concat_ws(":", "taxon", F.unix_date("since"), "x", "y")
    first = named.groupBy("component").agg(F.min(F.struct("since", "x", "y", "taxon")).alias("f")).select("component", "f.*").select("component", name.alias("chain"))
    named = named.join(first, "component").select("taxon", "x", "y", "since", "chain")
    return rows.join(named, ["taxon", "x", "y", "since"], "left").withColumns({"event": F.coalesce("chain", name), "chained": F.col("chain").isNotNull()}).drop("since", "chain")


def taxon_events(evidence: DataFrame, dominant: float = DOMINANT) -> DataFrame:
    """Of each taxon, from clustered evidence: raw, independent, observers, years, events, share of the largest event, and
    whether and why it may be a vagrant (dominated, one_year, candidate, reason)."""
    by_event = evidence.groupBy("taxon", "event").agg(F.count("*").alias("n"), F.sum("raw").alias("raw"), F.collect_set(F.year("day")).alias("years"))
    rows = by_event.groupBy("taxon").agg(F.sum("raw").alias("raw"), F.sum("n").alias("independent"), F.count("*").alias("events"), (F.max("n") / F.sum("n")).alias("share"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("years")))).alias("years"))
    seen = evidence.select("taxon", "observer").distinct().groupBy("taxon").agg(F.count("*").alias("observers"))
    rows = rows.withColumns({"dominated": F.col("share") >= dominant, "one_year": F.size("years") == 1})
    why = F.lit(None).cast("string")
    for (d, y), reason in REASONS.items():
        why = F.when((F.col("dominated") == d) & (F.col("one_year") == y), reason).otherwise(why)
    return rows.join(seen, "taxon").withColumns({"candidate": F.col("dominated") | F.col("one_year"), "reason": why})


def numbered_events(evidence: DataFrame, taxa: DataFrame, cap: float = EVENT_CAP) -> DataFrame:
    """Events of clustered evidence: taxon, event, number (from 1 within the taxon, by start, end, first cell and first report),
    start, end, independent, raw, observers, cells, weight, multiplier.

    taxa: as of `taxon_events`. Events of candidates weigh at most `cap`: their multiplier brings them down to it.
    Events are numbered within the year of their start and lifted by the numbers of the years before, so a taxon with very many has no task of its own.
    Different observers and cells are counted by rows of their own and meet in one sum.
    """
    key = ["taxon", "event"]
    seen = evidence.groupBy(*key, "observer").agg(
        F.min("day").alias("start"), F.max("day").alias("end"), F.count("*").alias("independent"), F.sum("raw").alias("raw"),
        F.min(F.struct("x", "y")).alias("first"), F.min("report").alias("report"), F.sum("weight").alias("weight"), F.lit(1).cast("bigint").alias("observers"), F.lit(0).cast("bigint").alias("cells"),
    )
    # An event that is one span lies in one cell.
    cells = evidence.filter("chained").select(*key, "x", "y").distinct().select(*key, F.lit(0).cast("bigint").alias("observers"), F.lit(1).cast("bigint").alias("cells"))
    rows = seen.drop("observer").unionByName(cells, allowMissingColumns=True).groupBy(*key).agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("independent").alias("independent"), F.sum("raw").alias("raw"), F.sum("observers").alias("observers"),
        F.greatest(F.sum("cells"), F.lit(1)).alias("cells"), F.min("first").alias("first"), F.min("report").alias("report"), F.sum("weight").alias("weight"),
    )
    rows = kept(rows.withColumn("year", F.coalesce(F.year("start"), F.lit(1 << 20))), "event-sums")
    before = W.partitionBy("taxon").orderBy("year").rowsBetween(W.unboundedPreceding, -1)
    years = rows.groupBy("taxon", "year").agg(F.count("*").alias("n")).withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))).join(taxa.select("taxon", "candidate"), "taxon")
    place = F.row_number().over(W.partitionBy("taxon", "year").orderBy("start", "end", "first", "report"))
    rows = rows.withColumn("place", place).join(years.drop("n"), ["taxon", "year"]).withColumn("number", F.col("before") + F.col("place"))
    scaled = F.when(F.col("candidate") & (F.col("weight") > cap), cap / F.col("weight")).otherwise(1.0)
    return rows.withColumn("multiplier", scaled).select("taxon", "event", "number", "start", "end", "independent", "raw", "observers", "cells", "weight", "multiplier")


def weighed(detections: DataFrame, evidence: DataFrame, events: DataFrame) -> DataFrame:
    """detections with number and effective (their weight, times their event's multiplier)."""
    who = F.coalesce(F.col("observer").cast("string"), F.concat(F.lit("report:"), F.col("report_id").cast("string")))
    of = evidence.select("taxon", F.col("observer").alias("who"), "day", "x", "y", "event").join(events.select("taxon", "event", "number", "multiplier"), ["taxon", "event"])
    rows = detections.withColumn("who", who).join(of, ["taxon", "who", "day", "x", "y"])
    return rows.withColumn("effective", F.col("weight") * F.col("multiplier")).drop("who", "event", "multiplier")

