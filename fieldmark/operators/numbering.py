"""Dense numbers for rows in a total order, without sorting all rows in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from fieldmark.sources.shared import kept


def numbered(df: DataFrame, name: str, *order: str) -> DataFrame:
    """df with `name`: 1, 2, ... in the given order, which must tell rows apart for reruns to agree.

    Rows are dealt into ranges and written once (the ranges come from a sample, so they must not be
    drawn again); a range's first number is the sum of the sizes of those before it, one row a range.
    """
    dealt = kept(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    place = F.row_number().over(W.partitionBy("_part").orderBy(*order))
    return dealt.join(F.broadcast(before), "_part").withColumn(name, F.col("_before") + place).drop("_part", "_before")
