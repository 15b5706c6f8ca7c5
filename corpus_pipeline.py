"""From raw documents to packed training sequences: five stages, each a DataFrame in and out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldmark.llm.common import stored, table
from fieldmark.llm.linededup import dedup_lines
from fieldmark.llm.mixing import mix
from fieldmark.llm.ngramjoin import near_duplicates
from fieldmark.llm.packing import pack_documents
from fieldmark.llm.toxicity import toxicity

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go, by the cut that it calibrates on labelled rows of its own."""
    rows = toxicity(docs, table(spark, sf_dir, "labels"), keep=("text", "lang", "source", "n_chars"))
    return rows.filter("NOT rejected").select(*COLUMNS)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; n_chars follows the text. A document that loses all its lines goes too, one that was empty before stays."""
    rows = dedup_lines(docs, keep=("lang", "source"))
    return rows.filter("n_dropped < n_lines OR n_dropped = 0").select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the least doc_id, and of several rows with
    that id and the same text one. Rows of one id with different texts are taken for one document and all stay; so do rows without an id."""
    near = near_duplicates(docs).filter("doc_id = component_id")
    groups = stored(near.groupBy(F.col("doc_id").alias("kept")).agg(F.count("*").alias("rows_of_id")), "kept-ids")
    of = lambda ids: docs.join(ids, docs["doc_id"] == ids["kept"], "left_semi").select(*COLUMNS)
    # Only rows of repeated ids are compared by text, so that other texts aren't shuffled for it.
    several = of(groups.filter("rows_of_id > 1")).withColumn("same", F.xxhash64("text")).dropDuplicates(["doc_id", "same"]).select(*COLUMNS)
    return of(groups.filter("rows_of_id = 1")).unionByName(several).unionByName(docs.filter("doc_id IS NULL").select(*COLUMNS))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents by how many of their words the mix takes: as many whole copies as taken / size, the fraction decided by a hash of doc_id.

    Documents without words have no share of the mix to settle and stay once.
    """
    docs = docs.select(*COLUMNS)  # other columns may have the names used below
    taken = mix(docs)
    share = F.col("taken") / F.col("size")
    chance = F.pmod(F.xxhash64("doc_id", "tie"), F.lit(1 << 30)) / float(1 << 30)
    copies = F.when(F.col("size") == 0, 1).otherwise(F.floor(share + chance))
    counts = taken.groupBy("doc_id", "tie").agg(F.max(copies).cast("int").alias("copies")).filter("copies > 0").select(F.col("doc_id").alias("d"), "tie", "copies")
    rows = docs.join(counts, docs["doc_id"].eqNullSafe(counts["d"]) & (F.xxhash64(docs["text"]) == counts["tie"]))
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their places in sequences of at most 4096 tokens."""
    return pack_documents(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing", mixing_stage),
    ("best-fit packing", packing_stage),
]

#: Compression distances and tokenisers have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
