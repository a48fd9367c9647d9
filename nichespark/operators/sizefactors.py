"""Per-sample log2 library size: counts per area by type, centred over samples, median over types."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def ls_matrix(cells: DataFrame, count: str = "n_count", area: str = "area") -> DataFrame:
    """(sample_id, cell_type, ls): log2 of counts per area less the type's mean over samples.

    Totals that aren't positive have no logarithm; they are null and left out of means and medians.
    """
    t = cells.groupBy("sample_id", "cell_type").agg(F.sum(count).alias("n"), F.sum(area).alias("a"))
    raw = F.when((F.col("n") > 0) & (F.col("a") > 0), F.log2(F.col("n") / F.col("a")))
    t = t.withColumn("raw", raw)
    return t.select("sample_id", "cell_type", (F.col("raw") - F.avg("raw").over(W.partitionBy("cell_type"))).alias("ls"))


def size_factors(cells: DataFrame, count: str = "n_count", area: str = "area") -> DataFrame:
    """(sample_id, ls)."""
    for c in (count, area):
        if c not in cells.columns:
            raise ValueError(f"column '{c}' not found in cells")
    return ls_matrix(cells, count, area).groupBy("sample_id").agg(F.median("ls").alias("ls"))


def compute_size_factors(cells: DataFrame, count: str = "n_count", area: str = "area", name: str = "LS") -> DataFrame:
    """cells plus the size factor of their sample."""
    return cells.drop(name).join(F.broadcast(size_factors(cells, count, area).withColumnRenamed("ls", name)), "sample_id", "left")
