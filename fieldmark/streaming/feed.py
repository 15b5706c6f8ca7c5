"""Event feeds as streams: running counts, and last-write-wins tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.sources.shared import shared_dir


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/feed-{uuid.uuid4().hex}"


def counted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """day, event_type, n of the events there are now. State holds one row a day and type; a rerun of a
    batch writes the same folder again, so a restart from the checkpoint counts nothing twice."""
    path = f"{sf_dir}/events.parquet"
    # A stream takes a plain path for a folder; as a pattern it may also be one file.
    events = spark.readStream.schema(spark.read.parquet(path).schema).parquet(f"{sf_dir}/[e]vents.parquet")
    counts = events.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type").agg(F.count("*").alias("n"))
    out = _folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/table/part={number}")

    counts.writeStream.outputMode("update").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    written = spark.read.schema("day string, event_type string, n long, batch int").option("recursiveFileLookup", "true").parquet(f"{out}/table")
    return written.groupBy("day", "event_type").agg(F.max_by("n", "batch").alias("n"))


def first_notices(spark: SparkSession, sf_dir: str, most: int = 8, delay: str = "40 days") -> DataFrame:
    """day, user_id: users with few errors (`most` at the most), once for each day on which they turn up. The state keeps a
    day's users for `delay`, which must cover how late events come; a rerun of a batch writes the same folder again."""
    path = f"{sf_dir}/events.parquet"
    known = spark.read.parquet(path)
    rare = known.filter("event_type = 'error'").groupBy("user_id").agg(F.count("*").alias("errors")).filter(F.col("errors") <= most).select("user_id")
    events = spark.readStream.schema(known.schema).parquet(f"{sf_dir}/[e]vents.parquet")
    seen = events.select("user_id", F.col("ts").cast("timestamp").alias("at"), F.date_format("ts", "yyyy-MM-dd").alias("day")).withWatermark("at", delay)
    first = seen.join(rare, "user_id").dropDuplicatesWithinWatermark(["day", "user_id"])
    out = _folder(spark)

    def put(batch: DataFrame, number: int) -> None:
        batch.select("day", "user_id").write.mode("overwrite").parquet(f"{out}/table/part={number}")

    first.writeStream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).foreachBatch(put).start().awaitTermination()
    return spark.read.schema(f"day string, user_id {dict(known.dtypes)['user_id']}").option("recursiveFileLookup", "true").parquet(f"{out}/table")


def latest(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The row of each key that is last in the given order: an aggregate, so hot keys shrink before the shuffle."""
    rest = [c for c in df.columns if c != key]
    out = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row"))
    return out.select(key, "row.*")
