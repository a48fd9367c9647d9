"""Hierarchical false-discovery control on result tables: niche, cell-type and patient layers.

Thresholds follow the layer: the niche cascade keeps q <= fdr, the other layers q < fdr. Two-sided
(Cauchy) evidence is adjusted once at gene and index level; one-sided (Brown) evidence is adjusted
per direction and doubled. Niche-level q is doubled in both cases.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.expr import bh_adjust, cauchy, clamp, pt, two_sided
from .combine import settled

NICHE_SCHEMA = "gene string, ct_index string, ct_niche string, bandwidth_max double, coef double, t double, DirectionGene string, DirectionIndex string, DirectionNiche string, fdr_gene double, fdr_index double, fdr_niche double"


def gene_index_fdr(pcomb: DataFrame, fdr: float, two_sided_p: bool) -> DataFrame:
    """(gene, ct_index, fdr_gene, fdr_index, direction) of pairs that pass both gates.

    pcomb(gene, level, ct_index, p_pos, p_neg) holds one Gene row and an Index row per index type.
    """
    times = 1.0 if two_sided_p else 2.0
    long = pcomb.select("gene", "level", "ct_index", F.lit(None).cast("string").alias("direction"), F.col("p_pos").alias("p")) if two_sided_p else pcomb.select("gene", "level", "ct_index", F.explode(F.array(F.struct(F.lit("Up").alias("direction"), F.col("p_pos").alias("p")), F.struct(F.lit("Down").alias("direction"), F.col("p_neg").alias("p")))).alias("r")).select("gene", "level", "ct_index", "r.direction", "r.p")
    same = lambda a, b: F.coalesce(F.col(a), F.lit("")) == F.coalesce(F.col(b), F.lit(""))
    gene = bh_adjust(long.where("level = 'Gene'").select("gene", "direction", "p"), "p", ["direction"], ["gene"], "fdr_gene", times)
    gene = gene.where(F.col("fdr_gene") <= fdr).select(F.col("gene").alias("g"), F.col("direction").alias("d"), "fdr_gene")
    index = long.where("level = 'Index'").join(gene, (F.col("gene") == F.col("g")) & same("direction", "d"))
    index = bh_adjust(index, "p", ["gene", "direction"], ["ct_index"], "fdr_index", times).where(F.col("fdr_index") <= fdr)
    first = F.min_by("direction", F.struct(F.col("fdr_index"), F.when(F.col("direction") == "Down", 1).otherwise(0)))
    return index.groupBy("gene", "ct_index").agg(F.min("fdr_gene").alias("fdr_gene"), F.min("fdr_index").alias("fdr_index"), F.when(F.count("*") == 2, F.lit("Both")).otherwise(first).alias("direction"))


def niche_records(wald: DataFrame, mode: str) -> DataFrame:
    """(gene, ct_index, ct_niche, sigma, t, coef, p) of the niche-tested columns; p is the smaller one-sided tail."""
    own = wald.where(F.col("type") == ("Niche" if mode == "niche" else "ResponseNiche"))
    tail = lambda lower: pt(F.col("t"), F.col("df"), lower)
    return own.select("gene", "ct_index", "ct_niche", "sigma", "t", "coef", F.least(tail(True), tail(False)).alias("p"))


def niche_level_fdr(records: DataFrame, pairs: DataFrame, weights: DataFrame, fdr: float) -> DataFrame:
    """(gene, ct_index, ct_niche, p_niche, bandwidth_max, t, coef, DirectionNiche, fdr_niche) within surviving pairs."""
    r = records.join(pairs.select("gene", "ct_index"), ["gene", "ct_index"], "left_semi").join(weights, ["gene", "sigma"])
    best = F.min_by(F.struct(F.col("sigma").alias("bandwidth_max"), "t", "coef"), F.struct("p", "sigma"))
    c = r.groupBy("gene", "ct_index", "ct_niche").agg(cauchy(F.col("p"), F.col("weight")).alias("p_niche"), best.alias("b"))
    c = c.select("gene", "ct_index", "ct_niche", "p_niche", "b.bandwidth_max", "b.t", "b.coef", F.when(F.col("b.t") > 0, "Up").otherwise("Down").alias("DirectionNiche"))
    return bh_adjust(c, "p_niche", ["gene", "ct_index"], ["ct_niche"], "fdr_niche", 2.0).where(F.col("fdr_niche") <= fdr)


def _direction(by: list[str]):
    w = W.partitionBy(*by)
    return F.when(F.min("t").over(w) > 0, "Up").when(F.max("t").over(w) < 0, "Down").otherwise("Both")


def hierarchical_fdr(pcomb: DataFrame, records: DataFrame, weights: DataFrame, fdr: float, two_sided_p: bool = True) -> DataFrame:
    """The niche layer: genes, then index types, then niches; ordered by fdr_niche and |t|."""
    pairs = settled(gene_index_fdr(pcomb, fdr, two_sided_p))
    out = niche_level_fdr(records, pairs, weights, fdr).join(pairs, ["gene", "ct_index"])
    if two_sided_p:
        out = out.withColumns({"DirectionGene": _direction(["gene"]), "DirectionIndex": _direction(["gene", "ct_index"])})
    else:
        out = out.withColumns({"DirectionGene": F.col("direction"), "DirectionIndex": F.col("direction")})
    cols = [c.split()[0] for c in NICHE_SCHEMA.split(", ")]
    return out.select(*cols).orderBy("fdr_niche", F.abs("t").desc(), "gene", "ct_index", "ct_niche")


def celltype_pvalues(wald: DataFrame, weights: DataFrame) -> DataFrame:
    """(gene, ct_index, p): two-sided p of the type:condition columns, combined over bandwidths."""
    rc = wald.where("type = 'ResponseCellType'").withColumn("p", two_sided(F.col("t"), F.col("df")))
    return rc.join(weights, ["gene", "sigma"]).groupBy("gene", "ct_index").agg(cauchy(F.col("p"), F.col("weight")).alias("p"))


def celltype_fdr(p: DataFrame, fdr: float) -> DataFrame:
    """(gene, ct_index, p, fdr_gene, fdr_celltype)."""
    gene = p.groupBy("gene").agg(cauchy(clamp(F.col("p"))).alias("pg"))
    gene = bh_adjust(gene, "pg", [], ["gene"], "fdr_gene").where(F.col("fdr_gene") < fdr).select("gene", "fdr_gene")
    out = bh_adjust(p.join(gene, "gene"), "p", ["gene"], ["ct_index"], "fdr_celltype").where(F.col("fdr_celltype") < fdr)
    return out.select("gene", "ct_index", "p", "fdr_gene", "fdr_celltype")


def patient_pvalues(patient: DataFrame, weights: DataFrame) -> DataFrame:
    """(gene, coef, p): the patient contrast combined over bandwidths; coef at the bandwidth of greatest weight (then smallest)."""
    t = patient.withColumn("p", two_sided(F.col("beta") / F.col("se_patient"), F.col("df"))).join(weights, ["gene", "sigma"])
    return t.groupBy("gene").agg(F.max_by("beta", F.struct("weight", -F.col("sigma"))).alias("coef"), cauchy(F.col("p"), F.col("weight")).alias("p"))


def patient_fdr(p: DataFrame, fdr: float) -> DataFrame:
    """(gene, coef, p, fdr, Direction)."""
    q = bh_adjust(p, "p", [], ["gene"], "fdr").where(F.col("fdr") < fdr)
    return q.select("gene", "coef", "p", "fdr", F.when(F.col("coef") > 0, "Up").otherwise("Down").alias("Direction"))


def direction_bh(t: DataFrame, fdr: float, family: list[str], ties: list[str], df: str | None = None) -> DataFrame:
    """One-bandwidth, direction-split BH on t: rows with q = min(1, 2 q_direction) < fdr, and their Direction (Both if both pass)."""
    ref = None if df is None else F.col(df)
    up = bh_adjust(t.withColumn("__p", pt(F.col("t"), ref, False)), "__p", family, ties, "__up", 2.0)
    both = bh_adjust(up.withColumn("__p", pt(F.col("t"), ref, True)), "__p", family, ties, "__down", 2.0)
    direction = F.when((F.col("__up") < fdr) & (F.col("__down") < fdr), "Both").when(F.col("__up") < fdr, "Up").otherwise("Down")
    return both.withColumns({"q": F.least("__up", "__down"), "Direction": direction}).where(F.col("q") < fdr).drop("__p", "__up", "__down")


def celltype_fdr_of_t(wald: DataFrame, fdr: float) -> DataFrame:
    """(gene, ct_index, t, p, fdr_gene, fdr_celltype, Direction) of one bandwidth's type:condition statistics."""
    rc = wald.where("type = 'ResponseCellType'").select("gene", "ct_index", "t", "df").withColumn("p", two_sided(F.col("t"), F.col("df")))
    gene = rc.groupBy("gene").agg(cauchy(clamp(F.col("p"))).alias("pg"))
    gene = bh_adjust(gene, "pg", [], ["gene"], "fdr_gene").where(F.col("fdr_gene") < fdr).select("gene", "fdr_gene")
    out = direction_bh(rc.join(gene, "gene"), fdr, ["gene"], ["ct_index"], "df")
    return out.select("gene", "ct_index", "t", "p", "fdr_gene", F.col("q").alias("fdr_celltype"), "Direction")


def patient_fdr_of_t(patient: DataFrame, fdr: float) -> DataFrame:
    """(gene, coef, se, t, p, fdr, Direction) of one bandwidth's patient contrast (gene, beta, se_patient, df)."""
    t = patient.select("gene", F.col("beta").alias("coef"), F.col("se_patient").alias("se"), (F.col("beta") / F.col("se_patient")).alias("t"), "df")
    out = direction_bh(t.withColumn("p", two_sided(F.col("t"), F.col("df"))), fdr, [], ["gene"], "df")
    return out.select("gene", "coef", "se", "t", "p", F.col("q").alias("fdr"), "Direction")
