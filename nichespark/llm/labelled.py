"""Bounded, reproducible samples of labelled rows for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Labelled documents that a fit may use; more are sampled by the hash of their ids.
SAMPLE = 20_000


def remainder(id_col: str, modulus: int) -> Column:
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % modulus


def sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held_out: int, text: str = "text", id_col: str = "doc_id", limit: int = SAMPLE) -> DataFrame:
    """(text, y) of at most `limit` labelled documents outside the held-out remainder.

    The chosen ids are collected (at most `limit` of them) and sent to the scan, so texts aren't shuffled.
    Ids with conflicting labels are left out.
    """
    y = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull() & (remainder(id_col, modulus) != held_out))
    y = y.groupBy(id_col).agg(F.min(label).cast("int").alias("y"), F.max(label).alias("top")).where("y = top").select(id_col, "y")
    ids = y.orderBy(F.xxhash64(id_col), id_col).limit(limit).collect()
    chosen = docs.sparkSession.createDataFrame([(r[0], r[1]) for r in ids], y.schema)
    return docs.select(F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text")).join(F.broadcast(chosen), id_col).select("text", "y")
