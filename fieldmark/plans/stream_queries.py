"""Registered queries over a paged feed that is read as a stream, and the SQL each is checked against."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from fieldmark.plans.checklist_queries import query
from fieldmark.sources.shared import shared_dir
from fieldmark.sources.tables import checklists, observers, table
from fieldmark.streaming import ingest

PAGE = 400  # report numbers of a page
FEED_SQL = f"""fd AS (SELECT o_custkey % 5 AS source, o_orderkey // {PAGE} + 1 AS page, o_orderkey AS seq, CASE WHEN o_orderkey % 50 = 7 THEN NULL WHEN o_orderkey % 50 = 9 THEN ' ' ELSE CAST(o_orderkey - CASE WHEN o_orderkey % 3 = 2 THEN 1 ELSE 0 END AS VARCHAR) END AS report_id, o_orderpriority AS origin FROM orders),
sv AS (SELECT DISTINCT CAST(l_orderkey AS VARCHAR) AS report_id FROM lineitem WHERE l_linenumber = 6), ar AS (SELECT trim(report_id) AS report_id, count(*) AS n FROM fd WHERE trim(report_id) <> '' GROUP BY 1)"""


def stream_of(spark, d, name):
    """A table as a stream. A plain path would be taken for a folder; as a pattern it may also be one file."""
    return spark.readStream.schema(spark.read.parquet(f"{d}/{name}.parquet").schema).parquet(f"{d}/[{name[0]}]{name[1:]}.parquet")


def feed(spark, d):
    """source, page, seq, report_id, origin: reports of five sources; some rows have no id, or that of the report before."""
    key = F.col("o_orderkey")
    number = (key - F.when(key % 3 == 2, 1).otherwise(0)).cast("string")
    named = F.when(key % 50 == 7, F.lit(None).cast("string")).when(key % 50 == 9, " ").otherwise(number)
    return stream_of(spark, d, "orders").select((F.col("o_custkey") % 5).cast("long").alias("source"), (F.floor(key / PAGE) + 1).alias("page"), key.cast("long").alias("seq"), named.alias("report_id"), F.col("o_orderpriority").alias("origin"))


def folder(spark) -> str:
    return f"{shared_dir(spark)}/ingest-{uuid.uuid4().hex}"


def saved(spark, d):
    return table(spark, d, "lineitem").filter("l_linenumber = 6").select(F.col("l_orderkey").cast("string").alias("report_id"))


@query(f"WITH {FEED_SQL} SELECT report_id, CASE WHEN sv.report_id IS NULL THEN 'claimed' ELSE 'existing' END AS reason FROM ar LEFT JOIN sv USING (report_id)", bound=False)
def stream_claims(spark, d):
    """Which reports of the feed are claimed, and which exist already; each once."""
    path = folder(spark)
    ingest.claims(feed(spark, d), saved(spark, d), path).awaitTermination()
    return ingest.claimed(spark, path).select("report_id", "reason")


@query(f"""WITH {FEED_SQL} SELECT CASE WHEN sv.report_id IS NULL THEN 'claimed' ELSE 'existing' END AS reason, count(*) AS n FROM ar LEFT JOIN sv USING (report_id) GROUP BY 1
UNION ALL SELECT 'missing', count(*) FROM fd WHERE report_id IS NULL OR trim(report_id) = '' HAVING count(*) > 0 UNION ALL SELECT 'duplicate', CAST(sum(n - 1) AS BIGINT) FROM ar HAVING sum(n - 1) > 0""", bound=False)
def stream_claim_counts(spark, d):
    """How many rows of the feed claim a report, find it existing, come again, or have no id."""
    path = folder(spark)
    for stream in (ingest.claims(feed(spark, d), saved(spark, d), path), ingest.arrivals(feed(spark, d), path)):
        stream.awaitTermination()
    return ingest.claim_counts(spark, path)


@query(f"""WITH {FEED_SQL}, pg AS (SELECT DISTINCT source, page FROM fd WHERE NOT (source = 3 AND page % 7 = 0)), al AS (SELECT source, page FROM pg UNION SELECT DISTINCT source, 0 FROM pg)
SELECT source, CAST(min(page) AS BIGINT) AS current FROM al WHERE NOT EXISTS (SELECT 1 FROM pg WHERE pg.source = al.source AND pg.page = al.page + 1) GROUP BY source""", bound=False)
def stream_watermark(spark, d):
    """How far each source's pages are complete without a gap; one source lacks every seventh page."""
    path = folder(spark)
    ingest.watermarks(feed(spark, d).filter("NOT (source = 3 AND page % 7 = 0)").select("source", "page"), path).awaitTermination()
    return ingest.current(spark, path)


@query(f"""WITH {FEED_SQL} SELECT source, CAST(max(page) AS BIGINT) AS page, arg_max(seq, (page, -seq)) AS rows, arg_max(origin, (page, -seq)) AS origin, arg_max(seq * 2, seq) AS total, CAST(greatest(1, max(page) - 4) AS BIGINT) AS resume FROM fd GROUP BY source""", bound=False)
def stream_progress(spark, d):
    """The furthest page of each source with the row that reached it first, the total said last, and the page that a restart begins with."""
    path = folder(spark)
    events = feed(spark, d).select("source", "seq", "page", F.col("seq").alias("rows"), (F.col("seq") * 2).alias("total"), "origin")
    ingest.progress(events, path).awaitTermination()
    return ingest.progressed(spark, path).withColumn("resume", ingest.resume_page(F.col("page")))


@query("""SELECT point, taxon, count(*) AS records, CASE WHEN count(*) = count(nullif(n, 1)) THEN round(sum(nullif(n, 1)), 6) END AS total FROM cl JOIN ob USING (report_id) JOIN pp USING (observer) GROUP BY point, taxon""")
def stream_place_totals(spark, d):
    """Totals by place and taxon, kept up as observations come; a count of 1 stands for an unknown number and makes the total null."""
    path = folder(spark)
    where = checklists(spark, d).select("report_id", "observer").join(observers(spark, d).select("observer", "point"), "observer").select("report_id", "point")
    rows = stream_of(spark, d, "lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").cast("long").alias("taxon"), F.nullif(F.col("l_quantity").cast("double"), F.lit(1.0)).alias("known"))
    keys = "point string, taxon long"
    ingest.running_totals(rows.join(where, "report_id"), keys, "known", path).awaitTermination()
    return ingest.totals(spark, path, keys).select("point", "taxon", F.col("rows").alias("records"), F.round("total", 6).alias("total"))
