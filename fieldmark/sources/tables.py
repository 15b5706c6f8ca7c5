"""Reads, and the binding of fact and dimension tables to checklist roles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checklists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, day, observer, state, kind."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("report_id"), F.col("o_orderdate").cast("date").alias("day"), F.col("o_custkey").alias("observer"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("kind"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """report_id, taxon, idx, n, red."""
    x = table(spark, sf_dir, "lineitem")
    return x.select(F.col("l_orderkey").alias("report_id"), F.col("l_partkey").alias("taxon"), F.col("l_linenumber").alias("idx"), F.col("l_quantity").cast("double").alias("n"), (F.col("l_returnflag") == "R").alias("red"))


def taxa(spark: SparkSession, sf_dir: str) -> DataFrame:
    """taxon, name, order_name, family."""
    p = table(spark, sf_dir, "part")
    return p.select(F.col("p_partkey").alias("taxon"), F.col("p_name").alias("name"), F.col("p_type").alias("order_name"), F.col("p_brand").alias("family"))


def observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """observer, point, city, province, lon, lat."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("city"), F.col("n_regionkey").alias("province"))
    k = F.col("c_custkey")
    c = c.select(k.alias("observer"), F.concat(F.lit("P"), k % 40).alias("point"), F.col("c_nationkey").alias("city"), (118 + (k * 37 % 500) / 100.0).cast("double").alias("lon"), (27 + (k * 53 % 400) / 100.0).cast("double").alias("lat"))
    return c.join(n, "city")


#: The same binding as SQL, for the statements that queries are checked against.
BINDING = """
cl AS (SELECT o_orderkey AS report_id, CAST(o_orderdate AS DATE) AS day, o_custkey AS observer, o_orderstatus AS state, o_orderpriority AS kind FROM orders),
ob AS (SELECT l_orderkey AS report_id, l_partkey AS taxon, l_linenumber AS idx, CAST(l_quantity AS DOUBLE) AS n, l_returnflag = 'R' AS red FROM lineitem),
tx AS (SELECT p_partkey AS taxon, p_name AS name, p_type AS order_name, p_brand AS family FROM part),
pp AS (SELECT c_custkey AS observer, concat('P', CAST(c_custkey % 40 AS VARCHAR)) AS point, c_nationkey AS city, n_regionkey AS province,
  CAST(118 + (c_custkey * 37 % 500) / 100.0 AS DOUBLE) AS lon, CAST(27 + (c_custkey * 53 % 400) / 100.0 AS DOUBLE) AS lat
  FROM customer JOIN nation ON c_nationkey = n_nationkey)
"""
