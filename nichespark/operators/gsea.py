"""Gene-set tests on Wald statistics with variance inflation for correlated genes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import special
from ..functions.expr import TINY, bh_adjust, cauchy, pt, two_sided
from .combine import relative_weights, settled


def _qnorm_batch(s: pd.Series) -> pd.Series:
    return pd.Series(special.qnorm(s.to_numpy(float)))


def _qnorm(p):
    return F.pandas_udf(_qnorm_batch, T.DoubleType())(p)


def t_to_z(t, df):
    """The normal deviate with t's tail probability (t itself without df); the tail is floored at the smallest double."""
    tail = F.greatest(pt(-F.abs(t), df, True), F.lit(TINY))
    z = -_qnorm(tail) * F.signum(t)
    return F.when(df.isNull(), t).when(t.isNull() | F.isnan(t), 0.0).otherwise(F.when(F.isnan(z), 0.0).otherwise(z))


def z_table(wald: DataFrame, mode: str, kind: str = "niche") -> DataFrame:
    """(sigma, gene, ct_index, ct_niche, z) of the tested columns of a layer."""
    want = "ResponseCellType" if kind == "celltype" else "Niche" if mode == "niche" else "ResponseNiche"
    own = wald.where(F.col("type") == want)
    if own.where("df is not null").isEmpty():
        return own.select("sigma", "gene", "ct_index", "ct_niche", F.col("t").alias("z"))
    return own.select("sigma", "gene", "ct_index", "ct_niche", t_to_z(F.col("t"), F.col("df")).alias("z"))


def usable_sets(genesets: DataFrame, genes: DataFrame, min_size: int = 5, max_size: int = 500) -> DataFrame:
    """(collection, geneset, gene, size): distinct fitted members of sets whose size is in range."""
    coll = F.coalesce(F.col("collection"), F.lit("all")) if "collection" in genesets.columns else F.lit("all")
    g = genesets.select(coll.alias("collection"), "geneset", "gene").distinct().join(genes.select("gene").distinct(), "gene", "left_semi")
    size = g.groupBy("collection", "geneset").agg(F.count("*").alias("size")).where(F.col("size").between(min_size, max_size))
    return g.join(size, ["collection", "geneset"])


def set_means(z: DataFrame, sets: DataFrame) -> DataFrame:
    """Mean z of every set's members for every tested column."""
    return z.join(sets, "gene").groupBy("sigma", "collection", "geneset", "size", "ct_index", "ct_niche").agg(F.avg("z").alias("zbar"))


def set_statistics(z: DataFrame, sets: DataFrame, rho: DataFrame, test: str = "competitive") -> DataFrame:
    """set_means plus stat: the set's mean over its standard error under correlation rho(sigma, rho)."""
    if test not in ("competitive", "self-contained"):
        raise ValueError("test must be competitive or self-contained")
    key = ["sigma", "ct_index", "ct_niche"]
    m = set_means(z, sets).join(F.broadcast(rho), "sigma")
    vif = 1 + F.col("rho") * (F.col("size") - 1)
    if test == "self-contained":
        return m.withColumn("stat", F.col("zbar") / F.sqrt(vif / F.col("size"))).drop("rho")
    tot = z.groupBy(*key).agg(F.sum("z").alias("tot"), F.count("*").alias("g"), F.stddev_samp("z").alias("sd")).withColumn("ct_niche", F.coalesce("ct_niche", F.lit("")))
    m = m.withColumn("cn", F.col("ct_niche")).withColumn("ct_niche", F.coalesce("ct_niche", F.lit(""))).join(tot, key)
    rest = F.col("g") - F.col("size")
    outside = (F.col("tot") - F.col("zbar") * F.col("size")) / rest
    stat = F.when(rest > 0, (F.col("zbar") - outside) / F.col("sd") / F.sqrt(vif / F.col("size") + 1 / rest))
    return m.select(*[c for c in m.columns if c not in ("ct_niche", "cn", "rho", "tot", "g", "sd")], F.col("cn").alias("ct_niche"), stat.alias("stat"))


def cascade(tab: DataFrame, fdr: float, nested: bool = True, per_collection: bool = False) -> DataFrame:
    """Set, then index type, then (nested) niche: each level re-corrects the rows that survived; all strictly below fdr.

    Every level reads the rows before it twice, so the result-sized tables between levels are computed once and end their plans.
    """
    tab = settled(tab)
    first = tab.groupBy("collection", "geneset").agg(cauchy(F.col("p")).alias("p_geneset"))
    first = bh_adjust(first, "p_geneset", ["collection"] if per_collection else [], ["collection", "geneset"], "fdr_geneset").where(F.col("fdr_geneset") < fdr)
    tab = settled(tab.join(first, ["collection", "geneset"]))
    second = tab.groupBy("collection", "geneset", "ct_index").agg(cauchy(F.col("p")).alias("p_index"))
    second = bh_adjust(second, "p_index", ["geneset"], ["collection", "ct_index"], "fdr_index").where(F.col("fdr_index") < fdr)
    tab = tab.join(second, ["collection", "geneset", "ct_index"])
    if not nested:
        return tab
    return bh_adjust(tab, "p", ["collection", "geneset", "ct_index"], ["ct_niche"], "fdr_niche").where(F.col("fdr_niche") < fdr)


def gene_set_test(wald: DataFrame, loglik: DataFrame, genesets: DataFrame, rho: DataFrame, mode: str = "condition", kind: str = "niche", test: str = "competitive", fdr: float = 0.05, min_size: int = 5, max_size: int = 500, weight_thresh: float = 0.1, per_collection: bool = False) -> DataFrame:
    """The gene-set layer. wald and loglik(sigma, gene, loglik) of all bandwidths; rho(sigma, rho)."""
    if kind not in ("niche", "celltype"):
        raise ValueError("kind must be niche or celltype")
    loglik = settled(loglik)
    sets = settled(usable_sets(genesets, loglik, min_size, max_size))
    stat = set_statistics(z_table(wald, mode, kind), sets, rho, test)
    ll = loglik.join(sets, "gene").groupBy("collection", "geneset", "sigma").agg(F.sum("loglik").alias("loglik")).withColumn("key", F.struct("collection", "geneset"))
    w = relative_weights(ll, "key", weight_thresh).select("key.*", "sigma", "weight")
    p = stat.withColumn("p", two_sided(F.col("stat"))).join(w, ["collection", "geneset", "sigma"])
    best = F.max_by(F.struct(F.col("sigma").alias("bandwidth_max"), F.col("stat").alias("z")), F.struct(F.abs("stat"), -F.col("sigma")))
    tab = p.groupBy("collection", "geneset", "size", "ct_index", "ct_niche").agg(cauchy(F.col("p"), F.col("weight")).alias("p"), best.alias("b"))
    tab = tab.select("collection", "geneset", "size", "ct_index", "ct_niche", "p", "b.bandwidth_max", "b.z", F.when(F.col("b.z") > 0, "Up").otherwise("Down").alias("Direction"))
    out = cascade(tab, fdr, kind == "niche", per_collection)
    cols = ["geneset", "collection", "size", "ct_index", *(["ct_niche"] if kind == "niche" else []), "bandwidth_max", "z", "Direction", "fdr_geneset", "fdr_index", *(["fdr_niche"] if kind == "niche" else [])]
    return out.select(*cols).orderBy("fdr_niche" if kind == "niche" else "fdr_index", F.abs("z").desc(), "geneset", "ct_index")


def inflation(wald: DataFrame) -> DataFrame:
    """(ct_index, lambda): median squared t over the median of a chi-square with one degree of freedom."""
    median = special.qnorm(0.75).item() ** 2
    return wald.groupBy("ct_index").agg((F.median(F.col("t") * F.col("t")) / F.lit(median)).alias("lambda"))
