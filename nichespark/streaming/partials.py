"""Size-factor sums and residual sums kept up to date by Structured Streaming.

The reference data are finite, so this is an extra: the additive partial sums of counts and area are
maintained in complete mode (state: one row per sample and type), and the centring and medians, which
aren't additive, are taken from the small state table when it is asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.sizefactors import size_factors


def start(stream: DataFrame, name: str, checkpoint: str, count: str = "n_count", area: str = "area"):
    """A running query that keeps sums of counts and area by sample and type in the in-memory table `name`."""
    sums = stream.groupBy("sample_id", "cell_type").agg(F.sum(count).alias("n_count"), F.sum(area).alias("area"))
    return sums.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def current(spark: SparkSession, name: str) -> DataFrame:
    """Size factors of all rows seen so far."""
    return size_factors(spark.table(name))


def start_rho(stream: DataFrame, name: str, checkpoint: str):
    """A running query over standardised residuals (cell_id, z), one row for each cell of every gene that arrives.

    State: one row per cell with its sum and number of genes, from which the mean correlation follows.
    """
    sums = stream.groupBy("cell_id").agg(F.sum("z").alias("s"), F.count("z").alias("genes"))
    return sums.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", checkpoint).start()


def current_rho(spark: SparkSession, name: str) -> float:
    """Mean correlation between the genes seen so far (0 for fewer than two); a gene's cells must have arrived together."""
    r = spark.table(name).agg(F.sum(F.col("s") * F.col("s")).alias("ss"), F.count("*").alias("n"), F.max("genes").alias("p")).first()
    return (r.ss / (r.n - 1) - r.p) / (r.p * (r.p - 1)) if r.p and r.p > 1 and r.n > 1 else 0.0
