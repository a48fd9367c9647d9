"""The estimator on designs with closed forms: registered queries and their SQL.

A tissue whose niches are zones (LEFT and RIGHT, between them a third of the cells in neither, with
densities such that log1p is 1 inside and 0 outside) has a design that is saturated in type, condition and
zone. Its maximum likelihood means are the groups' means whatever the dispersion, and its Gram matrices are
those of groups, so that the whole estimator - dispersions moderated over genes, likelihoods, Wald rows,
within-gene combination, weights of bandwidths, all layers - can be written in SQL. The queries run the
engine's own fit and inference; nothing here computes a statistic in Spark but the checks of designs without
closed form, whose score equations must vanish at the fitted coefficients. The two bandwidths are zones along
x (30) and along y (50).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import fit as fitting
from ..operators import gsea, nb
from ..operators import fdr as layers
from ..operators.inference import infer
from ..operators.niches import build_niches
from ..sources.tissue import order_tissue
from . import pipeline
from . import sqltext as sql

#: Thresholds at which every gate drops rows of the registered tables.
FDR_NICHE, FDR_CELLTYPE, FDR_PATIENT = 1e-6, 1e-4, 1e-2
DF = 12


def model_tissue(spark: SparkSession, sf: str):
    """The derived tissue with three types, so that small tables fill every stratum."""
    t = order_tissue(spark, sf)
    kind = F.when(F.col("cell_type").isin("AUTOMOBILE", "MACHINERY"), "A").when(F.col("cell_type").isin("BUILDING", "FURNITURE"), "B").otherwise("C")
    t.cells = t.cells.withColumn("cell_type", kind)
    return t


def zones(cells: DataFrame) -> DataFrame:
    """niches of two zones along x (bandwidth 30) and along y (50)."""
    inside = lambda c, side: F.col(c) < 166 if side == "LEFT" else F.col(c) >= 333
    rows = F.array(*[F.struct(F.lit(s).alias("sigma"), F.lit(side).alias("ct_niche"), F.when(inside(c, side), F.expm1(F.lit(1.0))).otherwise(0.0).alias("density")) for s, c in ((30.0, "x"), (50.0, "y")) for side in ("LEFT", "RIGHT")])
    return cells.select("cell_id", "sample_id", F.explode(rows).alias("r")).select("cell_id", "sample_id", "r.*")


def _rounded(df: DataFrame, *cols: str, d: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(F.col(c), d) for c in cols})


def _fit(spark, sf, condition: str | None = "condition"):
    t = model_tissue(spark, sf)
    return pipeline.fit(t.cells, t.counts, zones(t.cells), condition, winsor=None)


def _tested(spark, sf, condition: str | None = "condition", fdr: float = FDR_NICHE, combine: str = "cauchy"):
    return pipeline.test(_fit(spark, sf, condition), fdr, combine=combine)


def nb_fit(spark, sf):
    r = _fit(spark, sf)
    return _rounded(sql.union([f.genes.select(F.lit(f.sigma).alias("sigma"), "gene", "psi", "loglik") for f in r.fits]), "psi", "loglik", d=4)


def wald_full(spark, sf):
    return _rounded(_tested(spark, sf).wald().select("sigma", "gene", "covariate", "type", "ct_index", "ct_niche", "coef", "se", "t"), "coef", "se", "t", d=5)


def wald_niche(spark, sf):
    return _rounded(_tested(spark, sf, None).wald().select("sigma", "gene", "covariate", "ct_index", "ct_niche", "coef", "se", "t"), "coef", "se", "t", d=5)


def _mixed(spark, sf):
    """Inference of a penalised fit (here with penalty 0): whole inverse, Pearson scale, t with DF degrees of freedom."""
    r = _fit(spark, sf)
    for f in r.fits:
        f.penalty, f.df = np.zeros(len(f.design.terms)), float(DF)
        infer(f, r.packed, with_rho=False)
    return r


def wald_mixed(spark, sf):
    return _rounded(_mixed(spark, sf).wald().select("sigma", "gene", "covariate", "coef", "se", "t", "df"), "coef", "se", "t", d=5)


def pcomb_mixed(spark, sf):
    r = _mixed(spark, sf)
    return _rounded(sql.union([f.pcomb for f in r.fits]).select("sigma", "gene", "level", F.coalesce("ct_index", F.lit("")).alias("ct_index"), "p_pos"), "p_pos", d=5)


def t_to_z_tails(spark, sf):
    """Normal tails of the deviates that t statistics with DF degrees of freedom are turned into."""
    z = gsea.z_table(_mixed(spark, sf).wald(), "condition")
    return z.select("sigma", "gene", "ct_index", "ct_niche", F.round(expr.pnorm(-F.abs("z")), 5).alias("tail"), F.signum("z").cast("int").alias("sign"))


def brown_combine(spark, sf):
    p = sql.union([f.pcomb for f in _tested(spark, sf, combine="brown").fits])
    return _rounded(p.select("sigma", "gene", "level", F.coalesce("ct_index", F.lit("")).alias("ct_index"), "p_pos", "p_neg"), "p_pos", "p_neg", d=5)


def fitted_rho(spark, sf):
    r = _tested(spark, sf)
    return spark.createDataFrame([(f.sigma, round(f.rho, 7)) for f in r.fits], "sigma double, rho double")


def bandwidth_weights(spark, sf):
    return _rounded(_tested(spark, sf).weights.select("sigma", "gene", "weight"), "weight", d=4)


NICHE_COLUMNS = ("coef", "t", "fdr_gene", "fdr_index", "fdr_niche")


def pipeline_condition(spark, sf):
    return _rounded(_tested(spark, sf).results(), *NICHE_COLUMNS, d=4)


def pipeline_niche(spark, sf):
    return _rounded(_tested(spark, sf, None).results(), *NICHE_COLUMNS, d=4)


def pipeline_celltype(spark, sf):
    return _rounded(_tested(spark, sf, fdr=FDR_CELLTYPE).results("celltype"), "p", "fdr_gene", "fdr_celltype", d=4)


def pipeline_patient(spark, sf):
    return _rounded(_tested(spark, sf, fdr=FDR_PATIENT).results("patient"), "coef", "p", "fdr", d=4)


def celltype_one_bandwidth(spark, sf):
    f = _tested(spark, sf).fits[0]
    return _rounded(layers.celltype_fdr_of_t(f.wald, FDR_CELLTYPE), "t", "p", "fdr_gene", "fdr_celltype", d=4)


def patient_one_bandwidth(spark, sf):
    f = _tested(spark, sf).fits[0]
    return _rounded(layers.patient_fdr_of_t(f.patient, FDR_PATIENT), "coef", "se", "t", "p", "fdr", d=4)


# --- designs without closed form: the score equations vanish ----------------------------------


def score_equations(f: fitting.Fit, counts: DataFrame) -> DataFrame:
    """(gene, covariate, score): absolute penalised scores at the fitted coefficients, from the design's own rows."""
    design, p = f.design.frame(), len(f.design.terms)
    # a cell's counts come as a map to its row, so that rows times genes are summed where they arise
    own = counts.groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("gene", "n"))).alias("counts"))
    y = design.join(own, "cell_id", "left").crossJoin(F.broadcast(f.genes.select("gene", "alpha", "psi"))).withColumn("n", F.try_element_at("counts", F.col("gene")))
    eta = F.aggregate(F.zip_with("w", "alpha", lambda a, b: a * b), F.lit(0.0), lambda acc, x: acc + x)
    y = y.withColumn("mu", F.exp(eta)).withColumn("r", (F.coalesce("n", F.lit(0)) - F.col("mu")) / (1 + F.col("psi") * F.col("mu")))
    sums = y.groupBy("gene").agg(F.first("alpha").alias("alpha"), F.array(*[F.sum(F.col("w")[j] * F.col("r")) for j in range(p)]).alias("s"))
    pen = (f.penalty if f.penalty is not None else np.zeros(p)) + 1e-8
    names = F.array(*[F.lit(t.covariate) for t in f.design.terms])
    left = F.array(*[F.round(F.abs(F.col("s")[j] - float(pen[j]) * F.col("alpha")[j]), 2) + 0.0 for j in range(p)])
    return sums.select("gene", F.explode(F.arrays_zip(names.alias("covariate"), left.alias("score"))).alias("r")).select("gene", "r.covariate", "r.score")


def _fitted(spark, sf, **how):
    t = model_tissue(spark, sf)
    return t, pipeline.fit(t.cells, t.counts, build_niches(t.cells, [30.0]).persist(), "condition", winsor=None, **how).fits[0]


def nb_scores(spark, sf):
    t, f = _fitted(spark, sf)
    return score_equations(f, t.counts)


def mixed_fit(spark, sf):
    t, f = _fitted(spark, sf, random="intercept")
    return score_equations(f, t.counts)


def mixed_variance(spark, sf):
    """Variances of the random effects (no closed form: held by tests against brute force)."""
    f = _fitted(spark, sf, random="intercept")[1]
    return spark.createDataFrame([(k, round(v, 4)) for k, v in f.tau2.items()], "re_group string, tau2 double")


def mixed_df(spark, sf):
    """Degrees of freedom of the tested columns of a mixed fit."""
    f = _fitted(spark, sf, random="intercept")[1]
    return spark.createDataFrame([(f.design.terms[i].covariate, round(float(d), 2)) for i, d in zip(f.sel, f.df, strict=True)], "covariate string, df double")


TAU2 = 0.25


def satterthwaite_df(spark, sf):
    """Degrees of freedom of the intercept of a design of samples at unit working weights and a given variance."""
    n = {r["sample_id"]: r["n"] for r in model_tissue(spark, sf).cells.groupBy("sample_id").agg(F.count("*").alias("n")).collect()}
    d = np.array([n[k] for k in sorted(n)], float)
    a = np.block([[np.array([[d.sum()]]), d[None, :]], [d[:, None], np.diag(d)]])
    pen = np.array([0.0] + [1 / TAU2] * len(d))
    df = fitting.satterthwaite(a, np.linalg.inv(a + np.diag(pen)), pen, [np.arange(1, len(d) + 1)], [TAU2], np.array([0]), int(d.sum()))
    return spark.createDataFrame([("Intercept", round(float(df[0]), 4))], "covariate string, df double")


# --- SQL -------------------------------------------------------------------------------------


def _means(by: str) -> str:
    """Groups, their means, dispersions, likelihoods and weights d of groups, under both bandwidths."""
    step = "ln(1e6) / 42"
    assert len(nb.GRID) == 43 and np.allclose(nb.GRID, np.log(1e-4) + np.arange(43) * np.log(1e6) / 42) and nb.PRIOR_GENES == 10
    zone = lambda s, c: f"SELECT cell_id, cell_type, condition, {s}::DOUBLE AS sigma, CASE WHEN {c} < 166 THEN 1 WHEN {c} >= 333 THEN 2 ELSE 0 END AS zone FROM kinds"
    group = "sum(n / g * ln(1 / (1 + g * mu)) + total * ln(g * mu / (1 + g * mu)))"
    return f"""WITH {sql.CELLS},
{sql.COUNTS},
kinds AS (SELECT * REPLACE (CASE WHEN cell_type IN ('AUTOMOBILE', 'MACHINERY') THEN 'A' WHEN cell_type IN ('BUILDING', 'FURNITURE') THEN 'B' ELSE 'C' END AS cell_type) FROM cells),
z AS ({zone(30, 'x')} UNION ALL {zone(50, 'y')}),
gr AS (SELECT sigma, {by}, count(*) AS n FROM z GROUP BY ALL),
tot AS (SELECT gene, sigma, {by}, sum(k.n) AS total, sum(k.n * k.n) AS sq FROM counts k JOIN z USING (cell_id) GROUP BY ALL),
m AS (SELECT gene, sigma, {by}, n, CAST(coalesce(total, 0) AS DOUBLE) AS total, coalesce(sq, 0) AS sq, coalesce(total, 0) / n AS mu
  FROM (SELECT DISTINCT gene FROM counts) CROSS JOIN gr LEFT JOIN tot USING (gene, sigma, {by})),
grid AS (SELECT k, ln(1e-4) + k * {step} AS lp, exp(ln(1e-4) + k * {step}) AS g FROM range(43) t(k)),
hist AS (SELECT gene, n AS y, count(*) AS c FROM counts GROUP BY 1, 2),
yk AS (SELECT gene, k, sum(c * (lgamma(y + 1 / g) - lgamma(1 / g) - lgamma(y + 1.0))) AS a FROM hist CROSS JOIN grid GROUP BY 1, 2),
curve AS (SELECT gene, sigma, k, any_value(a) + {group} - 0.5 * sum(ln(n * mu / (1 + g * mu))) AS v FROM m CROSS JOIN grid JOIN yk USING (gene, k) GROUP BY 1, 2, 3),
post AS (SELECT gene, sigma, k, v + 10 * avg(v) OVER (PARTITION BY sigma, k) AS f FROM curve),
nbr AS (SELECT *, lag(f) OVER w AS l, lead(f) OVER w AS r, row_number() OVER (PARTITION BY gene, sigma ORDER BY f DESC, k) AS rk FROM post WINDOW w AS (PARTITION BY gene, sigma ORDER BY k)),
psi AS (SELECT gene, sigma, exp(lp + {step} * CASE WHEN l - 2 * f + r < 0 THEN greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * f + r))) ELSE 0 END) AS psi FROM nbr JOIN grid USING (k) WHERE rk = 1),
lh AS (SELECT gene, sigma, sum(c * (lgamma(y + 1 / psi) - lgamma(1 / psi) - lgamma(y + 1.0))) AS a FROM hist JOIN psi USING (gene) GROUP BY 1, 2),
loglik AS (SELECT gene, sigma, any_value(a) + {group} AS loglik FROM (SELECT *, psi AS g FROM m JOIN psi USING (gene, sigma)) JOIN lh USING (gene, sigma) GROUP BY 1, 2),
rel AS (SELECT gene, sigma, exp(loglik - max(loglik) OVER (PARTITION BY gene)) AS w FROM loglik),
weights AS (SELECT gene, sigma, CASE WHEN w < 0.1 THEN 0 ELSE w END AS weight FROM rel),
dd AS (SELECT m.*, psi, n * mu / (1 + psi * mu) AS d FROM m JOIN psi USING (gene, sigma))"""


SIDE = "CASE zone WHEN 1 THEN 'LEFT' ELSE 'RIGHT' END"
#: Rows of the type:condition (`wald`) and type:condition:zone columns (`nw`), with the variances of both kinds of fit.
RESPONSE = f"""{_means('cell_type, condition, zone')},
r AS (SELECT gene, sigma, cell_type AS ct_index, zone, any_value(psi) AS psi, max(mu) FILTER (condition = 'Treated') AS m1, max(mu) FILTER (condition = 'Control') AS m0,
  max(d) FILTER (condition = 'Treated') AS d1, max(d) FILTER (condition = 'Control') AS d0 FROM dd GROUP BY 1, 2, 3, 4),
wald AS (SELECT sigma, gene, ct_index, psi, ln(m1 / m0) AS coef, 1 / d1 AS v, 1 / d1 + 1 / d0 AS v_all, sqrt(psi / d1) AS se, ln(m1 / m0) / sqrt(psi / d1) AS t FROM r WHERE zone = 0),
nw0 AS (SELECT a.sigma, a.gene, a.ct_index, {SIDE.replace('zone', 'a.zone')} AS ct_niche, a.psi, ln(a.m1 / a.m0) - ln(b.m1 / b.m0) AS coef, 1 / a.d1 + 1 / b.d1 AS v, 1 / a.d1 + 1 / b.d1 + 1 / a.d0 + 1 / b.d0 AS v_all, 1 / b.d1 AS v_both
  FROM r a JOIN r b ON a.gene = b.gene AND a.sigma = b.sigma AND a.ct_index = b.ct_index AND b.zone = 0 AND a.zone > 0),
nw AS (SELECT *, sqrt(psi * v) AS se, coef / sqrt(psi * v) AS t FROM nw0)"""
NICHE = f"""{_means('cell_type, zone')},
nw AS (SELECT a.sigma, a.gene, a.cell_type AS ct_index, {SIDE.replace('zone', 'a.zone')} AS ct_niche, ln(a.mu / b.mu) AS coef, sqrt(a.psi / a.d) AS se, ln(a.mu / b.mu) / sqrt(a.psi / a.d) AS t
  FROM dd a JOIN dd b ON a.gene = b.gene AND a.sigma = b.sigma AND a.cell_type = b.cell_type AND b.zone = 0 AND a.zone > 0)"""


def _layer(base: str, fdr: float) -> str:
    return f"""{base},
{sql.gates()}, {sql.pairs(fdr)}, {sql.niche_level(fdr)}
SELECT gene, ct_index, ct_niche, bandwidth_max, round(coef, 4) AS coef, round(t, 4) AS t, {sql.DIRECTIONS},
  DirectionNiche, round(fdr_gene, 4) AS fdr_gene, round(fdr_index, 4) AS fdr_index, round(fdr_niche, 4) AS fdr_niche FROM nl JOIN pairs USING (gene, ct_index)"""


def _t_two(t: str) -> str:
    """Two-sided tail of t with DF (even) degrees of freedom, by its finite series."""
    cos2, terms, c = f"({DF} / ({DF} + ({t}) * ({t})))", ["1.0"], 1.0
    for k in range(1, DF // 2):
        c *= (2 * k - 1) / (2 * k)
        terms.append(f"{c!r} * pow({cos2}, {k})")
    return f"(1 - abs({t}) / sqrt({DF} + ({t}) * ({t})) * ({' + '.join(terms)}))"


#: Pearson scale over all cells less the 18 columns.
MIXED = f"""{RESPONSE},
sc AS (SELECT gene, sigma, sum((sq - n * mu * mu) / (mu + psi * mu * mu)) / ((SELECT count(*) FROM cells) - 18) AS scale FROM dd GROUP BY 1, 2),
mw AS (SELECT sigma, gene, ct_index, NULL AS ct_niche, coef, sqrt(scale * v_all) AS se, coef / sqrt(scale * v_all) AS t FROM wald JOIN sc USING (gene, sigma)
  UNION ALL SELECT sigma, gene, ct_index, ct_niche, coef, sqrt(scale * v_all), coef / sqrt(scale * v_all) FROM nw JOIN sc USING (gene, sigma))"""
COVARIATE = "'CellType' || ct_index || ':conditionTreated' || coalesce(':' || ct_niche, '')"
BROWN = f"""{RESPONSE},
one AS (SELECT sigma, gene, ct_index, {sql.upper('t')} AS up, {sql.upper('-t')} AS down, v, v_both FROM nw),
ix AS (SELECT sigma, gene, 'Index' AS level, ct_index, -2 * sum(ln(up)) AS xu, -2 * sum(ln(down)) AS xd, count(*) AS k, max(v_both) / sqrt(min(v) * max(v)) AS rr FROM one GROUP BY 1, 2, 4),
ix2 AS (SELECT *, 3.263 * rr + 0.710 * rr * rr + 0.027 * rr * rr * rr AS c FROM ix),
lv AS (SELECT sigma, gene, level, ct_index, xu, xd, k, c FROM ix2 UNION ALL SELECT sigma, gene, 'Gene', '', sum(xu), sum(xd), sum(k), sum(c) FROM ix2 GROUP BY 1, 2),
sc AS (SELECT *, (4 * k + 2 * c) / (4.0 * k) AS scale, 8.0 * k * k / (4 * k + 2 * c) AS df FROM lv)"""
CT_P = f"""pw AS (SELECT *, least(1.0, {sql.two_sided('t')}) AS p FROM wald),
ctp AS (SELECT gene, ct_index, {sql.cauchy('p', 'weight')} AS p FROM pw JOIN weights USING (gene, sigma) GROUP BY 1, 2)"""
SHARES = "aw AS (SELECT cell_type AS ct_index, count(*) / (SELECT count(*) FROM kinds) AS w FROM kinds GROUP BY 1), pc AS (SELECT sigma, gene, sum(w * coef) AS beta, sqrt(any_value(psi) * sum(w * w * v)) AS se FROM wald JOIN aw USING (ct_index) GROUP BY 1, 2)"
#: Direction-split adjustment: both tails within a family, doubled.
DIRECTED = "CASE WHEN qu < {0} AND qd < {0} THEN 'Both' WHEN qu < {0} THEN 'Up' ELSE 'Down' END AS Direction"


def _split(src: str, family: str, ties: str) -> str:
    """src with tails pu and pd, and their doubled adjusted values qu and qd."""
    up = f"(SELECT * EXCLUDE (__r, __n), {sql.bh('pu', family, ties, 2.0)} AS qu FROM {sql.ranked(src, 'pu', family, ties)})"
    return f"(SELECT * EXCLUDE (__r, __n), {sql.bh('pd', family, ties, 2.0)} AS qd FROM {sql.ranked(up, 'pd', family, ties)})"


def _zeros(random: bool) -> str:
    ts = "(VALUES ('A'), ('B'), ('C'))"
    more = f" UNION ALL SELECT 'Sample' || sample_id FROM (SELECT DISTINCT sample_id FROM cells)" if random else ""
    return f"""WITH {sql.CELLS},
{sql.COUNTS},
c AS (SELECT 'CellType' || t AS covariate FROM {ts} v(t) UNION ALL SELECT t FROM {ts} v(t) UNION ALL SELECT 'CellType' || t || ':conditionTreated' FROM {ts} v(t)
  UNION ALL SELECT 'CellType' || a.t || ':' || b.t FROM {ts} a(t), {ts} b(t) WHERE a.t <> b.t AND a.t <> 'A'
  UNION ALL SELECT 'CellType' || a.t || ':conditionTreated:' || b.t FROM {ts} a(t), {ts} b(t) WHERE a.t <> b.t{more})
SELECT gene, covariate, 0.0::DOUBLE AS score FROM (SELECT DISTINCT gene FROM counts), c"""


#: For one intercept and a random column per sample all matrices have closed forms in d (cells of a sample) and u = d / (d + 1 / tau2).
DF_SQL = f"""WITH {sql.CELLS},
d AS (SELECT sample_id AS s, CAST(count(*) AS DOUBLE) AS d, count(*) / (count(*) + {1 / TAU2}) AS u FROM cells GROUP BY 1),
f AS (SELECT sum(d) - sum(d * u) AS s0, sum(d) AS n, count(*) AS k FROM d),
minv AS (SELECT a.s AS i, b.s AS j, CASE WHEN a.s = b.s THEN 1 / (a.d + {1 / TAU2}) ELSE 0 END + a.u * b.u / s0 AS v, a.d AS di, b.d AS dj, a.u AS ui, b.u AS uj FROM d a, d b, f),
-- A_r' M^-1 A_r from A_r (first row d, then diag d) and the blocks of M^-1 (1/s0, -u/s0, v)
amat AS (SELECT i, j, di * dj * (v + 1 / s0 - ui / s0 - uj / s0) AS q, CASE WHEN i = j THEN di ELSE 0 END AS a FROM minv, f),
-- A_r' M^-1 L M^-1 A_r: c = L^(1/2) M^-1 A_r, entry (s, j)
cc AS (SELECT m.i AS s, m.j AS j, sqrt({1 / TAU2}) * m.dj * (m.v - m.ui / s0) AS c FROM minv m, f),
info AS (SELECT (SELECT 0.5 * (n - (k + 1) + (SELECT sum(v * v) * {(1 / TAU2) ** 2} FROM minv)) FROM f) AS pp,
  (SELECT 0.5 * sum((a - q) * (a - q)) FROM amat) AS aa,
  (SELECT 0.5 * (sum(CASE WHEN i = j THEN a - q END) - (SELECT sum(c * c) FROM cc)) FROM amat) AS pa),
g AS (SELECT 1 / s0 AS g1, {1 / TAU2 / TAU2} * (SELECT sum(u * u) FROM d) / (s0 * s0) AS g2, n FROM f)
SELECT 'Intercept' AS covariate, round(greatest(1, least(n, 2 * g1 * g1 * (pp * aa - pa * pa) / (g1 * g1 * aa - 2 * g1 * g2 * pa + g2 * g2 * pp))), 4) AS df FROM info, g"""


def oracle_sql() -> dict[str, str]:
    c = sql.CLAMPED
    return {
        "nb_fit": f"{RESPONSE} SELECT sigma, gene, round(psi, 4) AS psi, round(loglik, 4) AS loglik FROM psi JOIN loglik USING (gene, sigma)",
        "wald_full": f"""{RESPONSE} SELECT sigma, gene, {COVARIATE.replace(" || coalesce(':' || ct_niche, '')", '')} AS covariate, 'ResponseCellType' AS type, ct_index, NULL AS ct_niche, round(coef, 5) AS coef, round(se, 5) AS se, round(t, 5) AS t FROM wald
UNION ALL SELECT sigma, gene, {COVARIATE}, 'ResponseNiche', ct_index, ct_niche, round(coef, 5), round(se, 5), round(t, 5) FROM nw""",
        "wald_niche": f"{NICHE} SELECT sigma, gene, 'CellType' || ct_index || ':' || ct_niche AS covariate, ct_index, ct_niche, round(coef, 5) AS coef, round(se, 5) AS se, round(t, 5) AS t FROM nw",
        "wald_mixed": f"{MIXED} SELECT sigma, gene, {COVARIATE} AS covariate, round(coef, 5) AS coef, round(se, 5) AS se, round(t, 5) AS t, {DF}::DOUBLE AS df FROM mw",
        "pcomb_mixed": f"""{MIXED}, tp AS (SELECT sigma, gene, ct_index, {c.format(_t_two('t'))} AS p FROM mw WHERE ct_niche IS NOT NULL)
SELECT sigma, gene, 'Gene' AS level, '' AS ct_index, round({sql.cauchy('p')}, 5) AS p_pos FROM tp GROUP BY 1, 2 UNION ALL SELECT sigma, gene, 'Index', ct_index, round({sql.cauchy('p')}, 5) FROM tp GROUP BY 1, 2, 4""",
        "t_to_z_tails": f"{MIXED} SELECT sigma, gene, ct_index, ct_niche, round(0.5 * {_t_two('t')}, 5) AS tail, CAST(sign(t) AS INTEGER) AS sign FROM mw WHERE ct_niche IS NOT NULL",
        "brown_combine": f"{BROWN} SELECT sigma, gene, level, ct_index, round({sql.chi_upper('xu / scale', 'df')}, 5) AS p_pos, round({sql.chi_upper('xd / scale', 'df')}, 5) AS p_neg FROM sc",
        "fitted_rho": f"""{RESPONSE}, res AS (SELECT z.cell_id, dd.gene, dd.sigma, (coalesce(k.n, 0) - mu) / sqrt(mu + psi * mu * mu) AS e FROM z JOIN dd USING (sigma, cell_type, condition, zone) LEFT JOIN counts k ON k.cell_id = z.cell_id AND k.gene = dd.gene),
sd AS (SELECT gene, sigma, stddev_samp(e) AS sd, avg(e) AS em FROM res GROUP BY 1, 2), s AS (SELECT sigma, cell_id, sum((e - em) / sd) AS s FROM res JOIN sd USING (gene, sigma) GROUP BY 1, 2), p AS (SELECT sigma, count(*) AS p FROM sd GROUP BY 1)
SELECT sigma, round((sum(s * s) / (count(*) - 1) - max(p)) / (max(p) * (max(p) - 1)), 7) AS rho FROM s JOIN p USING (sigma) GROUP BY 1""",
        "bandwidth_weights": f"{RESPONSE} SELECT sigma, gene, round(weight, 4) AS weight FROM weights",
        "pipeline_condition": _layer(RESPONSE, FDR_NICHE),
        "pipeline_niche": _layer(NICHE, FDR_NICHE),
        "pipeline_celltype": f"""{RESPONSE}, {CT_P}, g AS (SELECT gene, {sql.cauchy(c.format('p'))} AS pg FROM ctp GROUP BY 1),
gq AS (SELECT gene, {sql.bh('pg', '', '')} AS fdr_gene FROM {sql.ranked('g', 'pg', '', 'gene')}), j AS (SELECT ctp.*, fdr_gene FROM ctp JOIN gq USING (gene) WHERE fdr_gene < {FDR_CELLTYPE})
SELECT gene, ct_index, round(p, 4) AS p, round(fdr_gene, 4) AS fdr_gene, round(q, 4) AS fdr_celltype FROM (SELECT *, {sql.bh('p', 'gene', '')} AS q FROM {sql.ranked('j', 'p', 'gene', 'ct_index')}) WHERE q < {FDR_CELLTYPE}""",
        "pipeline_patient": f"""{RESPONSE}, {SHARES}, p0 AS (SELECT *, least(1.0, {sql.two_sided('beta / se')}) AS p FROM pc),
p1 AS (SELECT gene, arg_max(beta, (weight, -sigma)) AS coef, {sql.cauchy('p', 'weight')} AS p FROM p0 JOIN weights USING (gene, sigma) GROUP BY 1)
SELECT gene, round(coef, 4) AS coef, round(p, 4) AS p, round(q, 4) AS fdr, CASE WHEN coef > 0 THEN 'Up' ELSE 'Down' END AS Direction FROM (SELECT *, {sql.bh('p', '', '')} AS q FROM {sql.ranked('p1', 'p', '', 'gene')}) WHERE q < {FDR_PATIENT}""",
        "celltype_one_bandwidth": f"""{RESPONSE}, w1 AS (SELECT gene, ct_index, t, {sql.upper('t')} AS pu, {sql.upper('-t')} AS pd, least(1.0, {sql.two_sided('t')}) AS p FROM wald WHERE sigma = 30),
g AS (SELECT gene, {sql.cauchy(c.format('p'))} AS pg FROM w1 GROUP BY 1), gq AS (SELECT gene, {sql.bh('pg', '', '')} AS fdr_gene FROM {sql.ranked('g', 'pg', '', 'gene')}),
j AS (SELECT w1.*, fdr_gene FROM w1 JOIN gq USING (gene) WHERE fdr_gene < {FDR_CELLTYPE})
SELECT gene, ct_index, round(t, 4) AS t, round(p, 4) AS p, round(fdr_gene, 4) AS fdr_gene, round(least(qu, qd), 4) AS fdr_celltype, {DIRECTED.format(FDR_CELLTYPE)} FROM {_split('j', 'gene', 'ct_index')} WHERE least(qu, qd) < {FDR_CELLTYPE}""",
        "patient_one_bandwidth": f"""{RESPONSE}, {SHARES}, p0 AS (SELECT gene, beta AS coef, se, beta / se AS t, {sql.upper('beta / se')} AS pu, {sql.upper('-beta / se')} AS pd, least(1.0, {sql.two_sided('beta / se')}) AS p FROM pc WHERE sigma = 30)
SELECT gene, round(coef, 4) AS coef, round(se, 4) AS se, round(t, 4) AS t, round(p, 4) AS p, round(least(qu, qd), 4) AS fdr, {DIRECTED.format(FDR_PATIENT)} FROM {_split('p0', '', 'gene')} WHERE least(qu, qd) < {FDR_PATIENT}""",
        "nb_scores": _zeros(False),
        "mixed_fit": _zeros(True),
        "satterthwaite_df": DF_SQL,
    }


def queries() -> dict:
    own = [nb_fit, wald_full, wald_niche, wald_mixed, pcomb_mixed, t_to_z_tails, brown_combine, fitted_rho, bandwidth_weights, pipeline_condition, pipeline_niche, pipeline_celltype, pipeline_patient, celltype_one_bandwidth, patient_one_bandwidth, nb_scores, mixed_fit, mixed_variance, mixed_df, satterthwaite_df]
    return {f.__name__: f for f in own}
