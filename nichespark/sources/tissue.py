"""Tissues from tables: stored Parquet bundles, and a deterministic one derived from order data.

The derived tissue uses integer arithmetic alone, so any SQL engine derives the same one: customers
are cells, nations (modulo 6) samples, market segments types, and a customer's count of a gene is
the number of its line items of a brand.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .simulate import Tissue


def read_bundle(spark: SparkSession, path: str) -> Tissue:
    return Tissue(spark.read.parquet(f"{path}/cells"), spark.read.parquet(f"{path}/counts"))


def write_bundle(tissue: Tissue, path: str) -> None:
    """Counts are laid out by gene, so later gene-wise reads prune files."""
    tissue.cells.write.mode("overwrite").parquet(f"{path}/cells")
    tissue.counts.repartitionByRange("gene").sortWithinPartitions("gene", "cell_id").write.mode("overwrite").parquet(f"{path}/counts")


def order_counts(spark: SparkSession, sf_dir: str, gene: str = "p_brand") -> DataFrame:
    """counts(gene, cell_id, n) of line items by customer and brand (or another column of part)."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    line = read("lineitem").select("l_orderkey", "l_partkey").join(read("part").select("p_partkey", F.col(gene).alias("gene")), F.col("l_partkey") == F.col("p_partkey"))
    own = line.join(read("orders").select("o_orderkey", "o_custkey").hint("shuffle_hash"), F.col("l_orderkey") == F.col("o_orderkey"))
    # a cell has few items of a brand, so partial counts would hold nearly as many rows; dealt by cell, counts also meet cells where they are
    own = own.select("gene", F.col("o_custkey").alias("cell_id")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "cell_id")
    return own.groupBy("gene", "cell_id").agg(F.count("*").alias("n"))


def order_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """cells without their total counts."""
    s = F.col("c_nationkey") % 6
    return spark.read.parquet(f"{sf_dir}/customer.parquet").select(
        F.col("c_custkey").alias("cell_id"),
        F.concat(F.lit("S"), s).alias("sample_id"),
        F.col("c_mktsegment").alias("cell_type"),
        ((F.col("c_custkey") * 7919) % 499).cast("double").alias("x"),
        ((F.col("c_custkey") * 104729) % 503).cast("double").alias("y"),
        F.when(s % 2 == 1, "Treated").otherwise("Control").alias("condition"),
        ((F.col("c_custkey") * 31) % 17 + 1).cast("double").alias("area"),
    )


def order_tissue(spark: SparkSession, sf_dir: str) -> Tissue:
    counts = order_counts(spark, sf_dir).persist()
    total = counts.groupBy("cell_id").agg(F.sum("n").alias("n_count"))
    cells = order_cells(spark, sf_dir).join(total, "cell_id", "left").withColumn("n_count", F.coalesce("n_count", F.lit(0)))
    return Tissue(cells.persist(), counts)
