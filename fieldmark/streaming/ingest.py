"""Ingest of a paged feed as a stream: each report claimed once, watermarks over pages that come in any order, progress, replay, running totals.

Every table that a stream writes is a folder a batch (`part=<number>`), and a batch that runs again after a
failure writes its own folder again, so nothing counts twice. What a batch needs of those before it, it reads from folders
with lower numbers only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

CLAIM = "source long, page long, seq long, report_id string, reason string"
PROGRESS = "source long, top struct<page:long,rows:long,origin:string,seq:long>, total long, last long"
#: Pages that a restarted feed reads again, so that rows which came late aren't lost.
OVERLAP = 5


def parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The rows that all batches have written, with their number as `batch`."""
    return spark.read.schema(f"{schema}, batch int").option("recursiveFileLookup", "true").parquet(path)


def part(spark: SparkSession, path: str, schema: str, number: int) -> DataFrame:
    """The rows of one batch. Only its folder is listed, as the running batch's own may be from a failed run and about to go."""
    return spark.read.schema(schema).parquet(f"{path}/part={number}")


def put(rows: DataFrame, path: str, number: int) -> None:
    rows.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/part={number}")


def first_part(spark: SparkSession, path: str, schema: str, rows: DataFrame | None = None) -> None:
    """What stands before batch 0: the given rows or none. A restart writes the same again."""
    put(spark.createDataFrame([], schema) if rows is None else rows, path, -1)


def started(stream: DataFrame, path: str, write, mode: str = "append") -> StreamingQuery:
    """Works on all that is there now and stops; the folder's checkpoint goes on from there when it is started again."""
    return stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(write).start()


def claims(feed: DataFrame, saved: DataFrame, path: str) -> StreamingQuery:
    """Writes source, page, seq, report_id, reason to `path`/claims: each report once, at the first of its rows that comes.

    The reason is `existing` where `saved` (report_id, as it is when the batch runs) has the report, else `claimed`. The ids seen stay in the
    stream's state for good, as a report must never be claimed again; blank and null ids take no part.
    """
    first = feed.filter(F.btrim("report_id") != "").withColumn("report_id", F.btrim("report_id")).dropDuplicates(["report_id"])
    known = saved.select(F.btrim("report_id").alias("known")).distinct()
    first_part(feed.sparkSession, f"{path}/claims", CLAIM)

    def write(batch: DataFrame, number: int) -> None:
        rows = batch.join(known, F.col("report_id") == F.col("known"), "left")
        put(rows.select("source", "page", "seq", "report_id", F.when(F.col("known").isNull(), "claimed").otherwise("existing").alias("reason")), f"{path}/claims", number)

    return started(first, f"{path}/first", write)


def arrivals(feed: DataFrame, path: str) -> StreamingQuery:
    """Writes source, rows, missing (rows without an id), running totals, to `path`/arrivals."""
    blank = F.coalesce(F.btrim("report_id") == "", F.lit(True))
    total = feed.groupBy("source").agg(F.count("*").alias("rows"), F.count_if(blank).alias("missing"))
    first_part(feed.sparkSession, f"{path}/arrivals", "source long, rows long, missing long")
    return started(total, f"{path}/rows", lambda batch, number: put(batch, f"{path}/arrivals", number), "update")


def claimed(spark: SparkSession, path: str) -> DataFrame:
    return parts(spark, f"{path}/claims", CLAIM).drop("batch")


def claim_counts(spark: SparkSession, path: str) -> DataFrame:
    """reason, n: of all rows that came; a row that is neither a report's first nor without an id is a duplicate."""
    last = parts(spark, f"{path}/arrivals", "source long, rows long, missing long").groupBy("source").agg(F.max("rows").alias("rows"), F.max("missing").alias("missing"))
    known = claimed(spark, path).groupBy("reason").agg(F.count("*").alias("n"))
    came = last.agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"), F.coalesce(F.sum("missing"), F.lit(0)).alias("missing"))
    first = known.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("first"))
    # One row each.
    rest = came.crossJoin(first).select(F.inline(F.array(F.struct(F.lit("missing").alias("reason"), F.col("missing").alias("n")), F.struct(F.lit("duplicate").alias("reason"), (F.col("rows") - F.col("missing") - F.col("first")).alias("n")))))
    return known.unionByName(rest).filter("n > 0")


def advanced(now: DataFrame, pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Watermarks (source, current) after pages (source, page) are complete, and the pages (source, page) that still wait for one before them.

    A watermark moves to the first page whose next one isn't complete: pages without a successor are found by an anti join and
    the least of them by a sum of parts, so a source with very many pages has no task of its own. It never falls.
    """
    now = now.unionByName(pages.select("source").distinct().join(now, "source", "left_anti").select("source", F.lit(0).cast("long").alias("current")))
    ahead = pages.join(now, "source").filter(F.col("page") > F.col("current")).select("source", "page").distinct()
    chain = ahead.unionByName(now.select("source", F.col("current").alias("page")))
    ends = chain.join(ahead.select("source", (F.col("page") - 1).alias("page")), ["source", "page"], "left_anti")
    moved = ends.groupBy("source").agg(F.min("page").alias("current"))
    return moved, ahead.join(moved, "source").filter(F.col("page") > F.col("current")).select("source", "page")


def watermarks(pages: DataFrame, path: str, initial: DataFrame | None = None) -> StreamingQuery:
    """Keeps source, current in `path`/current: the last page of which all before are complete too. pages: source, page; initial: source, current."""
    spark = pages.sparkSession
    first_part(spark, f"{path}/current", "source long, current long", initial)
    first_part(spark, f"{path}/waiting", "source long, page long")

    def write(batch: DataFrame, number: int) -> None:
        before = part(spark, f"{path}/current", "source long, current long", number - 1)
        waiting = part(spark, f"{path}/waiting", "source long, page long", number - 1)
        new = batch.select("source", F.greatest("page", F.lit(0)).cast("long").alias("page")).distinct()
        moved, left = advanced(before, new.unionByName(waiting))
        put(left, f"{path}/waiting", number)
        put(moved, f"{path}/current", number)

    return started(pages, f"{path}/pages", write)


def current(spark: SparkSession, path: str) -> DataFrame:
    """source, current after the last batch."""
    return parts(spark, f"{path}/current", "source long, current long").groupBy("source").agg(F.max_by("current", "batch").alias("current"))


def progress(events: DataFrame, path: str) -> StreamingQuery:
    """Writes what each batch of progress events (source, seq, page, rows, total, origin) adds to `path`/progress, one row a source."""

    first_part(events.sparkSession, f"{path}/progress", PROGRESS)

    def write(batch: DataFrame, number: int) -> None:
        put(summed(batch.withColumn("batch", F.lit(number))), f"{path}/progress", number)

    return started(events, f"{path}/events", write)


def summed(events: DataFrame) -> DataFrame:
    """One row a source: the furthest page with its rows and origin, from the event that reached it first; total and seq of the last event. Order: batch, then seq."""
    came = F.struct("batch", "seq")
    first = F.struct("page", (-F.col("batch")).alias("b"), (-F.col("seq")).alias("s"))
    return events.groupBy("source").agg(F.max_by(F.struct("page", "rows", "origin", "seq"), first).alias("top"), F.max_by("total", came).alias("total"), F.max("seq").alias("last"))


def progressed(spark: SparkSession, path: str) -> DataFrame:
    """source, page, rows, origin, total: page and rows never go back, whatever comes later; total is the last one said."""
    rows = parts(spark, f"{path}/progress", PROGRESS)
    first = F.struct("top.page", (-F.col("batch")).alias("b"))
    return rows.groupBy("source").agg(F.max_by("top", first).alias("top"), F.max_by("total", "batch").alias("total")).select("source", "top.page", "top.rows", "top.origin", "total")


def resume_page(page: Column, overlap: int = OVERLAP) -> Column:
    """Where a feed that had come to `page` starts again: the last `overlap` pages are read once more; at page 1 if there was none."""
    return F.when(F.coalesce(page, F.lit(0)) <= 0, F.lit(1)).otherwise(F.greatest(F.lit(1), page - F.lit(overlap) + 1)).cast("long")


def running_totals(rows: DataFrame, keys: str, value: str, path: str) -> StreamingQuery:
    """Writes each batch's share of the totals of `value` by keys (DDL) to `path`/totals: rows, known (rows with a value) and their sum."""
    names = [k.split()[0] for k in keys.split(",")]
    first_part(rows.sparkSession, f"{path}/totals", f"{keys}, rows long, known long, sum double")

    def write(batch: DataFrame, number: int) -> None:
        put(batch.groupBy(*names).agg(F.count("*").alias("rows"), F.count(value).alias("known"), F.sum(value).alias("sum")), f"{path}/totals", number)

    return started(rows, f"{path}/shares", write)


def totals(spark: SparkSession, path: str, keys: str) -> DataFrame:
    """keys (as DDL), rows, total: of all batches; null where any row had no value."""
    shares = parts(spark, f"{path}/totals", f"{keys}, rows long, known long, sum double")
    names = [k.split()[0] for k in keys.split(",")]
    out = shares.groupBy(*names).agg(F.sum("rows").alias("rows"), F.sum("known").alias("known"), F.sum("sum").alias("sum"))
    return out.select(*names, "rows", F.when(F.col("rows") == F.col("known"), F.col("sum")).alias("total"))
