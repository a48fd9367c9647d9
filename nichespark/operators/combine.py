"""Evidence across bandwidths: relative-likelihood weights and weighted Cauchy combination."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import cauchy


def settled(df: DataFrame) -> DataFrame:
    """A result-sized table, computed now, so that plans which read it begin there.

    Layers read the rows before them several times; a persisted table would keep its whole plan in each of
    them, which the driver copies and compares at every step. Kept in the checkpoint folder if there is one.
    """
    return df.checkpoint() if df.sparkSession.sparkContext.getCheckpointDir() else df.localCheckpoint()


def union(frames: list[DataFrame]) -> DataFrame:
    """Rows of all bandwidths; columns that one lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def relative_weights(loglik: DataFrame, key: str = "gene", thresh: float = 0.1) -> DataFrame:
    """(key, sigma, weight): exp(loglik - best loglik of the key), 0 below thresh; the best bandwidth has exactly 1."""
    w = F.exp(F.col("loglik") - F.max("loglik").over(W.partitionBy(key)))
    return loglik.select(key, "sigma", F.when(w < thresh, 0.0).otherwise(w).alias("weight"))


def combine_bandwidths(pvalues: DataFrame, weights: DataFrame, by: list[str], columns: list[str], key: str = "gene") -> DataFrame:
    """Weighted Cauchy combination over sigma of each p column, per `by`."""
    j = pvalues.join(weights, [key, "sigma"])
    return j.groupBy(*by).agg(*[cauchy(F.col(c), F.col("weight")).alias(c) for c in columns])
