"""Grid cells, their rings, and splits by cell."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def cell(per_degree: int = 5) -> tuple[Column, Column]:
    """x and y of the grid cell that lon and lat fall into."""
    return F.floor(F.col("lon") * per_degree).alias("x"), F.floor(F.col("lat") * per_degree).alias("y")


def ring(df: DataFrame, reach: int = 1) -> DataFrame:
    """Each row once for its cell (x, y) and each cell around it."""
    step = lambda c: F.explode(F.sequence(F.col(c) - reach, F.col(c) + reach))
    return df.withColumn("x", step("x")).withColumn("y", step("y"))


def split_by_cell(cells: DataFrame, chosen: Column) -> DataFrame:
    """cells with role: validation where chosen, buffer in the ring of such a cell, training elsewhere."""
    marked = cells.withColumn("chosen", chosen)
    near = ring(marked.filter("chosen").select("x", "y")).distinct().withColumn("near", F.lit(True))
    role = F.when(F.col("chosen"), "validation").when(F.col("near"), "buffer").otherwise("training")
    return marked.join(near, ["x", "y"], "left").withColumn("role", role).drop("chosen", "near")
