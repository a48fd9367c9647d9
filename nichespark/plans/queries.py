"""Registered queries on the driver's tables and the SQL that gives the same rows."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..operators import fdr as layers
from ..operators import fit as fitting
from ..operators import gsea, score
from ..operators.combine import combine_bandwidths, relative_weights, settled, union
from ..operators.design import build_design
from ..operators.niches import build_niches, detect_sigmas, merge_niches, self_niches
from ..operators.sizefactors import ls_matrix, size_factors
from ..sources.simulate import Tissue
from ..sources.tissue import order_cells, order_counts, order_tissue
from . import closed, validate
from .sqltext import CELLS, CLAMPED, COUNTS, bh, cauchy, gates, mass, niche_level, pairs, ranked, two_sided

PSI = {30.0: 0.5, 50.0: 1.0}
SIGMAS = list(PSI)
RHO = 0.01
#: A threshold at which the gates on score statistics drop rows.
FDR = 0.95


def _r(c, d: int = 6):
    return F.round(c, d)


def _rounded(df: DataFrame, *cols: str, d: int = 6) -> DataFrame:
    return df.withColumns({c: _r(F.col(c), d) for c in cols})


def _density(edge: bool, diggle: bool):
    def run(spark, sf):
        return _rounded(build_niches(order_cells(spark, sf), [30], edge, diggle, pad=False), "density").select("cell_id", "ct_niche", "density")

    return run


def niche_padded(spark, sf):
    return _rounded(build_niches(order_cells(spark, sf), SIGMAS), "density")


def _merged(spark, sf):
    n = build_niches(order_cells(spark, sf), [30])
    m, g = merge_niches(n, {"HOME": ["HOUSEHOLD", "FURNITURE"], "NONE": ["UNKNOWN"]})
    return n, m, g


def niche_merge(spark, sf):
    return _rounded(_merged(spark, sf)[1], "density").select("cell_id", "ct_niche", "density")


def niche_merge_composed(spark, sf):
    _, m, g = _merged(spark, sf)
    return merge_niches(m, {"LARGE": ["HOME", "BUILDING"]}, None, g)[1]


def self_niche_drop(spark, sf):
    return self_niches(_merged(spark, sf)[2])


def detect_sigma(spark, sf):
    return detect_sigmas(build_niches(order_cells(spark, sf), SIGMAS))


def q_ls_matrix(spark, sf):
    return _rounded(ls_matrix(order_tissue(spark, sf).cells), "ls")


def q_size_factors(spark, sf):
    return _rounded(size_factors(order_tissue(spark, sf).cells), "ls")


def _design(spark, sf, **how):
    cells = order_cells(spark, sf).persist()  # the builder reads its types, levels and samples
    return build_design(cells, build_niches(cells, [30]), 30, "condition", covariates=["area"], **how)


def design_coefmap(spark, sf):
    return _design(spark, sf).coefmap(spark).drop("re_group")


def design_random_columns(spark, sf):
    c = _design(spark, sf, random="slope").coefmap(spark)
    return c.groupBy("type", "re_group").agg(F.count("*").alias("columns"))


def design_matrix_long(spark, sf):
    return _design(spark, sf).frame().select("cell_id", F.posexplode("w").alias("pos", "w")).withColumn("w", _r(F.col("w"))).where("w <> 0")


def tested_columns(spark, sf):
    d = _design(spark, sf)
    flags = [(i, bool(a), bool(b)) for i, (a, b) in enumerate(zip(d.tested, d.niche_tested, strict=True))]
    return d.coefmap(spark).join(spark.createDataFrame(flags, "pos int, tested boolean, niche boolean"), "pos").where("tested").select("covariate", "niche")


def sample_condition_check(spark, sf):
    return validate.sample_levels(order_cells(spark, sf), ["condition", "cell_type"])


def stratified_sample_sizes(spark, sf):
    c = order_cells(spark, sf)
    return fitting.stratified_cells(c, 0.1, 20).join(c, "cell_id").groupBy("sample_id", "cell_type").agg(F.count("*").alias("n"))


def cell_abundance_weights(spark, sf):
    return _rounded(score.abundance_weights(order_cells(spark, sf)), "w")


GROUPS = ["cell_type", "condition"]


def nb_group_means(spark, sf):
    t = order_tissue(spark, sf)
    return _rounded(score.group_means(t.cells, t.counts, GROUPS), "mu").withColumn("total", F.col("total").cast("long"))


def _loglik(t):
    m = score.group_means(t.cells, t.counts, GROUPS)
    return union([score.group_loglik(t.cells, t.counts, m, GROUPS, psi).withColumn("sigma", F.lit(s)) for s, psi in PSI.items()])


def nb_loglik_fixed_psi(spark, sf):
    return _rounded(_loglik(order_tissue(spark, sf)), "loglik", d=4)


def pearson_dispersion(spark, sf):
    t = order_tissue(spark, sf)
    m = score.group_means(t.cells, t.counts, GROUPS)
    return _rounded(score.pearson_dispersion(t.cells, t.counts, m, GROUPS, 0.5, 10), "dispersion")


def pearson_residual_rho(spark, sf):
    t = order_tissue(spark, sf)
    m = score.group_means(t.cells, t.counts, GROUPS)
    return _rounded(score.residual_correlation(t.cells, t.counts, m, GROUPS, 0.5), "rho", d=8)


#: The likelihoods of the two dispersions differ by far more than bandwidths do; a share of them serves as bandwidth evidence.
LL_SHARE = 0.001


def _weights(t):
    return settled(relative_weights(_loglik(t).withColumn("loglik", F.col("loglik") * LL_SHARE)))


def gene_weights(spark, sf):
    return _rounded(_weights(order_tissue(spark, sf)), "weight")


def _wald(t):
    m = score.group_means(t.cells, t.counts, GROUPS)
    return union([score.response_wald(m, ["Control", "Treated"], psi, s) for s, psi in PSI.items()])


def _niche_wald(t):
    return settled(score.niche_scores(t.cells, t.counts, build_niches(t.cells, SIGMAS), PSI))


def _order_niche_wald(spark, sf):
    """For queries that read nothing else of the tissue: counts are read once and cells need no totals, so neither is kept."""
    return _niche_wald(Tissue(order_cells(spark, sf), order_counts(spark, sf)))


def response_wald(spark, sf):
    return _rounded(_wald(order_tissue(spark, sf)), "coef", "se", "t").select("sigma", "gene", "ct_index", "coef", "se", "t")


def niche_score_z(spark, sf):
    return _rounded(_order_niche_wald(spark, sf), "t", "coef").select("sigma", "gene", "ct_index", "ct_niche", "t", "coef")


def _celltype_p(t):
    return layers.celltype_pvalues(_wald(t), _weights(t))


def cauchy_combine(spark, sf):
    return _rounded(_celltype_p(order_tissue(spark, sf)), "p")


def bh_gene(spark, sf):
    p = _celltype_p(order_tissue(spark, sf)).groupBy("gene").agg(expr.cauchy(expr.clamp(F.col("p"))).alias("p"))
    return _rounded(expr.bh_adjust(p, "p", [], ["gene"], "q"), "p", "q")


def bh_nested(spark, sf):
    return _rounded(expr.bh_adjust(_celltype_p(order_tissue(spark, sf)), "p", ["gene"], ["ct_index"], "q"), "p", "q")


def celltype_fdr(spark, sf):
    return _rounded(layers.celltype_fdr(_celltype_p(order_tissue(spark, sf)), 0.9), "p", "fdr_gene", "fdr_celltype")


def patient_fdr(spark, sf):
    t = order_tissue(spark, sf)
    p = layers.patient_pvalues(score.patient_contrast(_wald(t), score.abundance_weights(t.cells)), _weights(t))
    return _rounded(layers.patient_fdr(p, 0.9), "coef", "p", "fdr")


def _pcomb(wald):
    own = wald.withColumn("p", expr.clamp(expr.two_sided(F.col("t"))))
    p = lambda c: expr.cauchy(F.col("p")).alias(c)
    gene = own.groupBy("gene", "sigma").agg(p("p_pos")).select("gene", "sigma", F.lit("Gene").alias("level"), F.lit("").alias("ct_index"), "p_pos")
    index = own.groupBy("gene", "sigma", "ct_index").agg(p("p_pos")).select("gene", "sigma", F.lit("Index").alias("level"), "ct_index", "p_pos")
    return gene.unionByName(index).withColumn("p_neg", F.col("p_pos"))


def _gates(t):
    w = _weights(t)
    wald = _niche_wald(t)
    return wald, w, settled(combine_bandwidths(_pcomb(wald), w, ["gene", "level", "ct_index"], ["p_pos", "p_neg"]))


def gene_index_fdr(spark, sf):
    _, _, p = _gates(order_tissue(spark, sf))
    return _rounded(layers.gene_index_fdr(p, FDR, True).drop("direction"), "fdr_gene", "fdr_index")


def niche_level_fdr(spark, sf):
    wald, w, p = _gates(order_tissue(spark, sf))
    out = layers.niche_level_fdr(layers.niche_records(wald, "niche"), layers.gene_index_fdr(p, 0.97, True), w, FDR)
    return _rounded(out, "p_niche", "t", "coef", "fdr_niche")


def hierarchical_fdr(spark, sf):
    wald, w, p = _gates(order_tissue(spark, sf))
    return _rounded(layers.hierarchical_fdr(p, layers.niche_records(wald, "niche"), w, FDR), "coef", "t", "fdr_gene", "fdr_index", "fdr_niche")


def _sets(spark, sf):
    b = spark.read.parquet(f"{sf}/part.parquet").select(F.col("p_brand").alias("gene")).distinct()
    head, digit = F.substring("gene", 1, 7), F.substring("gene", 8, 1)
    return b.select(F.lit("first").alias("collection"), head.alias("geneset"), "gene").unionByName(b.select(F.lit("second").alias("collection"), F.concat(F.lit("ends "), digit).alias("geneset"), "gene"))


def _rho(spark):
    return spark.createDataFrame([(s, RHO) for s in SIGMAS], "sigma double, rho double")


def set_means(spark, sf):
    z = gsea.z_table(_order_niche_wald(spark, sf), "niche")
    return _rounded(gsea.set_means(z, gsea.usable_sets(_sets(spark, sf), z, 3)), "zbar").drop("size")


def _set_stat(test):
    def run(spark, sf):
        z = gsea.z_table(_order_niche_wald(spark, sf), "niche")
        out = gsea.set_statistics(z, gsea.usable_sets(_sets(spark, sf), z, 3), _rho(spark), test)
        return _rounded(out, "stat").select("sigma", "geneset", "ct_index", "ct_niche", "stat")

    return run


def gsea_cascade(spark, sf):
    t = order_tissue(spark, sf)
    ll = _loglik(t).withColumn("loglik", F.col("loglik") * LL_SHARE)
    out = gsea.gene_set_test(_niche_wald(t), ll, _sets(spark, sf), _rho(spark), "niche", fdr=0.999, min_size=3)
    return _rounded(out, "z", "fdr_geneset", "fdr_index", "fdr_niche")


def lambda_by_celltype(spark, sf):
    return _rounded(gsea.inflation(_order_niche_wald(spark, sf)), "lambda")


# --- SQL -------------------------------------------------------------------------------------

def _niche_sql(sigmas, edge=True, diggle=True) -> str:
    e = f"({mass('x', 'x0', 'x1', 'sigma')}) * ({mass('y', 'y0', 'y1', 'sigma')})" if edge else "1.0"
    by = "j.e" if diggle else "i.e"
    return f"""box AS (SELECT sample_id, min(x) AS x0, max(x) AS x1, min(y) AS y0, max(y) AS y1 FROM cells GROUP BY 1),
src AS (SELECT c.*, sigma, {e} AS e FROM cells c JOIN box USING (sample_id), (SELECT unnest([{', '.join(f'{float(s)}::DOUBLE' for s in sigmas)}]) AS sigma)),
near AS (SELECT i.cell_id, i.sample_id, i.sigma, j.cell_type AS ct_niche, sum(0.5 * exp(-((i.x - j.x) * (i.x - j.x) + (i.y - j.y) * (i.y - j.y)) / (2 * i.sigma * i.sigma)) / {by}) AS density
  FROM src i JOIN src j ON i.sample_id = j.sample_id AND i.sigma = j.sigma GROUP BY 1, 2, 3, 4),
niches AS (SELECT c.cell_id, c.sample_id, s.sigma, t.cell_type AS ct_niche, coalesce(n.density, 0) AS density FROM cells c
  CROSS JOIN (SELECT DISTINCT sigma FROM src) s CROSS JOIN (SELECT DISTINCT cell_type FROM cells) t LEFT JOIN near n ON n.cell_id = c.cell_id AND n.sigma = s.sigma AND n.ct_niche = t.cell_type)"""


MEANS = """means AS (SELECT g.gene, k.cell_type, k.condition, k.n_cells, CAST(coalesce(s.total, 0) AS DOUBLE) AS total, coalesce(s.total, 0) / k.n_cells AS mu
  FROM (SELECT DISTINCT gene FROM counts) g CROSS JOIN (SELECT cell_type, condition, count(*) AS n_cells FROM cells GROUP BY 1, 2) k
  LEFT JOIN (SELECT gene, cell_type, condition, sum(n) AS total FROM counts JOIN cells USING (cell_id) GROUP BY 1, 2, 3) s ON s.gene = g.gene AND s.cell_type = k.cell_type AND s.condition = k.condition)"""
PSIS = "psis(sigma, psi) AS (VALUES " + ", ".join(f"(CAST({s} AS DOUBLE), CAST({p} AS DOUBLE))" for s, p in PSI.items()) + ")"
LOGLIK = """loglik AS (SELECT m.gene, sigma, sum(m.n_cells * ln(1 / psi / (1 / psi + m.mu)) / psi) + coalesce(max(o.more), 0) AS loglik FROM means m CROSS JOIN psis
  LEFT JOIN (SELECT c.gene, sigma AS s2, sum(lgamma(c.n + 1 / psi) - lgamma(1 / psi) - lgamma(c.n + 1.0) + c.n * ln(m.mu / (1 / psi + m.mu))) AS more
    FROM counts c JOIN cells USING (cell_id) JOIN means m ON m.gene = c.gene AND m.cell_type = cells.cell_type AND m.condition = cells.condition CROSS JOIN psis GROUP BY 1, 2) o ON o.gene = m.gene AND o.s2 = sigma GROUP BY 1, 2)"""


def _weight_sql(src: str, key: str, out: str) -> str:
    w = f"exp(({LL_SHARE}) * (loglik - max(loglik) OVER (PARTITION BY {key})))"
    return f"{out} AS (SELECT {key}, sigma, CASE WHEN {w} < 0.1 THEN 0 ELSE {w} END AS weight FROM {src})"


WEIGHTS = _weight_sql("loglik", "gene", "weights")
WALD = """wald AS (SELECT sigma, l.gene, l.cell_type AS ct_index, ln(h.mu / l.mu) AS coef, sqrt(psi * (1 + psi * h.mu) / (h.n_cells * h.mu)) AS se, ln(h.mu / l.mu) / sqrt(psi * (1 + psi * h.mu) / (h.n_cells * h.mu)) AS t
  FROM means l JOIN means h ON l.gene = h.gene AND l.cell_type = h.cell_type AND l.condition = 'Control' AND h.condition = 'Treated' CROSS JOIN psis WHERE l.mu > 0 AND h.mu > 0)"""


CT_P = f"""pw AS (SELECT *, least(1.0, {two_sided('t')}) AS p FROM wald),
ctp AS (SELECT gene, ct_index, {cauchy('p', 'weight')} AS p FROM pw JOIN weights USING (gene, sigma) GROUP BY 1, 2)"""
SCORES = f"""d AS (SELECT n.cell_id, n.sigma, n.ct_niche, c.cell_type AS ct_index, ln(1 + n.density) AS x FROM niches n JOIN cells c USING (cell_id) WHERE c.cell_type <> n.ct_niche),
mom AS (SELECT sigma, ct_index, ct_niche, avg(x) AS xm, var_samp(x) * (count(*) - 1) AS sxx FROM d GROUP BY 1, 2, 3),
mu1 AS (SELECT gene, cell_type AS ct_index, sum(total) / sum(n_cells) AS mu FROM means GROUP BY 1, 2),
sxy AS (SELECT gene, sigma, ct_index, ct_niche, sum(n * x) AS yx, sum(n) AS ys FROM counts JOIN d USING (cell_id) GROUP BY 1, 2, 3, 4),
nw AS (SELECT sigma, gene, ct_index, ct_niche, (yx - ys * xm) / (1 + psi * mu) / (mu / (1 + psi * mu) * sxx) AS coef, (yx - ys * xm) / (1 + psi * mu) / sqrt(mu / (1 + psi * mu) * sxx) AS t
  FROM sxy JOIN mom USING (sigma, ct_index, ct_niche) JOIN mu1 USING (gene, ct_index) JOIN psis USING (sigma) WHERE sxx > 0 AND mu > 0)"""
BASE = f"WITH {CELLS},\n{COUNTS}"
CLOSED = f"{BASE},\n{PSIS},\n{MEANS},\n{LOGLIK},\n{WEIGHTS},\n{WALD}"
NICHE = f"{BASE},\n{PSIS},\n{MEANS},\n{LOGLIK},\n{WEIGHTS},\n{_niche_sql(SIGMAS)},\n{SCORES}"
GATES = f"{NICHE},\n{gates()}"


SETS = """sets0 AS (SELECT 'first' AS collection, substr(p_brand, 1, 7) AS geneset, p_brand AS gene FROM part UNION SELECT 'second', 'ends ' || substr(p_brand, 8, 1), p_brand FROM part),
sets AS (SELECT * FROM (SELECT s.*, count(*) OVER (PARTITION BY collection, geneset) AS size FROM sets0 s SEMI JOIN nw USING (gene)) WHERE size BETWEEN 3 AND 500)"""
STAT = f"""zb AS (SELECT sigma, collection, geneset, size, ct_index, ct_niche, avg(t) AS zbar FROM nw JOIN sets USING (gene) GROUP BY ALL),
tot AS (SELECT sigma, ct_index, ct_niche, sum(t) AS tot, count(*) AS g, stddev_samp(t) AS sd FROM nw GROUP BY ALL),
stat AS (SELECT zb.*, (zbar - (tot - zbar * size) / (g - size)) / sd / sqrt((1 + {RHO} * (size - 1)) / size + 1 / (g - size)) AS stat, zbar / sqrt((1 + {RHO} * (size - 1)) / size) AS self FROM zb JOIN tot USING (sigma, ct_index, ct_niche))"""
CASCADE = f"""sll AS (SELECT collection, geneset, sigma, sum(loglik) AS loglik FROM loglik JOIN sets USING (gene) GROUP BY ALL),
{_weight_sql('sll', 'collection, geneset', 'sw')},
st AS (SELECT collection, geneset, size, ct_index, ct_niche, {cauchy('p', 'weight')} AS p, arg_max(sigma, (abs(stat), -sigma)) AS bandwidth_max, arg_max(stat, (abs(stat), -sigma)) AS z
  FROM (SELECT *, least(1.0, {two_sided('stat')}) AS p FROM stat) JOIN sw USING (collection, geneset, sigma) GROUP BY ALL),
l1 AS (SELECT collection, geneset, {cauchy('p')} AS p FROM st GROUP BY ALL),
q1 AS (SELECT * FROM (SELECT collection, geneset, {bh('p', '', '')} AS fdr_geneset FROM {ranked('l1', 'p', '', 'collection, geneset')}) WHERE fdr_geneset < 0.999),
l2 AS (SELECT collection, geneset, ct_index, {cauchy('p')} AS p FROM st SEMI JOIN q1 USING (collection, geneset) GROUP BY ALL),
q2 AS (SELECT * FROM (SELECT collection, geneset, ct_index, {bh('p', 'geneset', '')} AS fdr_index FROM {ranked('l2', 'p', 'geneset', 'collection, ct_index')}) WHERE fdr_index < 0.999),
l3 AS (SELECT * FROM st JOIN q1 USING (collection, geneset) JOIN q2 USING (collection, geneset, ct_index))"""


def _sel(density: str) -> str:
    return f"SELECT cell_id, ct_niche, round({density}, 6) AS density"


COEFMAP = """ts AS (SELECT cell_type AS t, row_number() OVER (ORDER BY cell_type) AS ti FROM (SELECT DISTINCT cell_type FROM cells)),
terms AS (SELECT 0 AS b, 0 AS o, 0 AS i, 'area' AS covariate, 'Other' AS type, NULL AS ct_index, NULL AS ct_niche
  UNION ALL SELECT 1, 0, ti, 'CellType' || t, 'CellType', t, NULL FROM ts
  UNION ALL SELECT 2, 0, ti, t, 'Other', NULL, t FROM ts
  UNION ALL SELECT 3, 0, ti, 'CellType' || t || ':conditionTreated', 'ResponseCellType', t, NULL FROM ts
  UNION ALL SELECT 4, n.ti, c.ti, 'CellType' || c.t || ':' || n.t, 'Niche', c.t, n.t FROM ts c, ts n WHERE c.t <> n.t AND c.ti > 1
  UNION ALL SELECT 5, n.ti, c.ti, 'CellType' || c.t || ':conditionTreated:' || n.t, 'ResponseNiche', c.t, n.t FROM ts c, ts n WHERE c.t <> n.t),
coefmap AS (SELECT CAST(30 AS DOUBLE) AS sigma, CAST(row_number() OVER (ORDER BY b, o, i) - 1 AS INTEGER) AS pos, covariate, type, ct_index, ct_niche FROM terms)"""
HOME = "CASE WHEN ct_niche IN ('HOUSEHOLD', 'FURNITURE') THEN 'HOME' ELSE ct_niche END"
MEMBERS = f"members AS (SELECT DISTINCT CAST(30 AS DOUBLE) AS sigma, {HOME.replace('ct_niche', 'cell_type')} AS niche, cell_type AS member FROM cells)"
TOTAL = f"WITH {CELLS},\n{COUNTS},\ntot AS (SELECT cell_id, sum(n) AS n_count FROM counts GROUP BY 1),\nls0 AS (SELECT sample_id, cell_type, log2(sum(coalesce(n_count, 0)) / sum(area)) AS raw FROM cells LEFT JOIN tot USING (cell_id) GROUP BY 1, 2),\nls AS (SELECT sample_id, cell_type, raw - avg(raw) OVER (PARTITION BY cell_type) AS ls FROM ls0)"
RESID = f"""{BASE},
{MEANS},
m AS (SELECT *, sqrt(mu + 0.5 * mu * mu) AS s FROM means WHERE mu > 0),
z AS (SELECT c.cell_id, m.gene, (coalesce(k.n, 0) - m.mu) / m.s AS z FROM cells c JOIN m USING (cell_type, condition) LEFT JOIN counts k ON k.cell_id = c.cell_id AND k.gene = m.gene)"""

SQL = {
    "niche_density_noedge": f"WITH {CELLS}, {_niche_sql([30], False)} {_sel('density')} FROM near",
    "niche_density_edge": f"WITH {CELLS}, {_niche_sql([30], True, False)} {_sel('density')} FROM near",
    "niche_density_diggle": f"WITH {CELLS}, {_niche_sql([30])} {_sel('density')} FROM near",
    "niche_padded": f"WITH {CELLS}, {_niche_sql(SIGMAS)} SELECT cell_id, sample_id, sigma, ct_niche, round(density, 6) AS density FROM niches",
    "niche_merge": f"WITH {CELLS}, {_niche_sql([30])} SELECT cell_id, {HOME} AS ct_niche, round(sum(density), 6) AS density FROM niches GROUP BY 1, 2 UNION ALL SELECT cell_id, 'NONE', 0 FROM cells",
    "niche_merge_composed": f"WITH {CELLS}, {MEMBERS} SELECT DISTINCT sigma, CASE WHEN niche IN ('HOME', 'BUILDING') THEN 'LARGE' ELSE niche END AS niche, member FROM members",
    "self_niche_drop": f"WITH {CELLS}, {MEMBERS} SELECT DISTINCT sigma, member AS ct_index, niche AS ct_niche FROM members",
    "detect_sigma": "SELECT unnest([30.0::DOUBLE, 50.0::DOUBLE]) AS sigma",
    "ls_matrix": f"{TOTAL} SELECT sample_id, cell_type, round(ls, 6) AS ls FROM ls",
    "size_factors": f"{TOTAL} SELECT sample_id, round(median(ls), 6) AS ls FROM ls GROUP BY 1",
    "design_coefmap": f"WITH {CELLS}, {COEFMAP} SELECT * FROM coefmap",
    "design_random_columns": f"""WITH {CELLS}, {COEFMAP}, s AS (SELECT count(DISTINCT sample_id) AS s FROM cells)
SELECT type, NULL AS re_group, count(*) AS columns FROM coefmap GROUP BY 1 UNION ALL SELECT 'Random', 'SampleInt', s FROM s UNION ALL SELECT 'Random', 'SampleSlope', s * (SELECT count(*) FROM coefmap WHERE type = 'Niche') FROM s""",
    "design_matrix_long": f"""WITH {CELLS}, {_niche_sql([30])}, {COEFMAP},
v AS (SELECT c.cell_id, k.pos, (CASE WHEN k.type = 'Other' OR c.cell_type = k.ct_index THEN 1.0 ELSE 0.0 END) * (CASE WHEN k.type LIKE 'Response%' AND c.condition <> 'Treated' THEN 0.0 ELSE 1.0 END)
  * (CASE WHEN k.covariate = 'area' THEN c.area ELSE 1.0 END) * coalesce(ln(1 + n.density), 1.0) AS w
  FROM cells c CROSS JOIN coefmap k LEFT JOIN niches n ON n.cell_id = c.cell_id AND n.ct_niche = k.ct_niche)
SELECT cell_id, pos, round(w, 6) AS w FROM v WHERE round(w, 6) <> 0""",
    "tested_columns": f"WITH {CELLS}, {COEFMAP} SELECT covariate, type = 'ResponseNiche' AS niche FROM coefmap WHERE type LIKE 'Response%'",
    "sample_condition_check": f"WITH {CELLS} SELECT sample_id, count(DISTINCT condition) AS condition, count(DISTINCT cell_type) AS cell_type FROM cells GROUP BY 1",
    "stratified_sample_sizes": f"WITH {CELLS} SELECT sample_id, cell_type, least(count(*), greatest(CAST(ceil(0.1 * count(*)) AS BIGINT), 20)) AS n FROM cells GROUP BY 1, 2",
    "cell_abundance_weights": f"WITH {CELLS} SELECT cell_type AS ct_index, round(count(*) / (SELECT count(*) FROM cells), 6) AS w FROM cells GROUP BY 1",
    "nb_group_means": f"{BASE}, {MEANS} SELECT gene, cell_type, condition, n_cells, CAST(total AS BIGINT) AS total, round(mu, 6) AS mu FROM means",
    "nb_loglik_fixed_psi": f"{BASE}, {PSIS}, {MEANS}, {LOGLIK} SELECT gene, sigma, round(loglik, 4) AS loglik FROM loglik",
    "pearson_dispersion": f"{RESID} SELECT gene, round(sum(z * z) / greatest((SELECT count(*) FROM cells) - 10, 1), 6) AS dispersion FROM z GROUP BY 1",
    "pearson_residual_rho": f"""{RESID}, sd AS (SELECT gene, stddev_samp(z) AS sd, avg(z) AS zm FROM z GROUP BY 1),
s AS (SELECT cell_id, sum((z - zm) / sd) AS s FROM z JOIN sd USING (gene) GROUP BY 1), p AS (SELECT count(*) AS p FROM sd)
SELECT round((sum(s * s) / (count(*) - 1) - max(p)) / (max(p) * (max(p) - 1)), 8) AS rho FROM s, p""",
    "gene_weights": f"{CLOSED} SELECT gene, sigma, round(weight, 6) AS weight FROM weights",
    "response_wald": f"{CLOSED} SELECT sigma, gene, ct_index, round(coef, 6) AS coef, round(se, 6) AS se, round(t, 6) AS t FROM wald",
    "niche_score_z": f"{NICHE} SELECT sigma, gene, ct_index, ct_niche, round(t, 6) AS t, round(coef, 6) AS coef FROM nw",
    "cauchy_combine": f"{CLOSED}, {CT_P} SELECT gene, ct_index, round(p, 6) AS p FROM ctp",
    "bh_gene": f"{CLOSED}, {CT_P}, g AS (SELECT gene, {cauchy(CLAMPED.format('p'))} AS p FROM ctp GROUP BY 1) SELECT gene, round(p, 6) AS p, round({bh('p', '', '')}, 6) AS q FROM {ranked('g', 'p', '', 'gene')}",
    "bh_nested": f"{CLOSED}, {CT_P} SELECT gene, ct_index, round(p, 6) AS p, round({bh('p', 'gene', '')}, 6) AS q FROM {ranked('ctp', 'p', 'gene', 'ct_index')}",
    "celltype_fdr": f"""{CLOSED}, {CT_P}, g AS (SELECT gene, {cauchy(CLAMPED.format('p'))} AS pg FROM ctp GROUP BY 1),
gq AS (SELECT gene, {bh('pg', '', '')} AS fdr_gene FROM {ranked('g', 'pg', '', 'gene')}), j AS (SELECT ctp.*, fdr_gene FROM ctp JOIN gq USING (gene) WHERE fdr_gene < 0.9)
SELECT * FROM (SELECT gene, ct_index, round(p, 6) AS p, round(fdr_gene, 6) AS fdr_gene, round({bh('p', 'gene', '')}, 6) AS fdr_celltype FROM {ranked('j', 'p', 'gene', 'ct_index')}) WHERE fdr_celltype < 0.9""",
    "patient_fdr": f"""{CLOSED}, aw AS (SELECT cell_type AS ct_index, count(*) / (SELECT count(*) FROM cells) AS w FROM cells GROUP BY 1),
c AS (SELECT sigma, gene, sum(w * coef) AS beta, sqrt(sum(w * se * w * se)) AS se FROM wald JOIN aw USING (ct_index) GROUP BY 1, 2), p0 AS (SELECT *, least(1.0, {two_sided('beta / se')}) AS p FROM c),
p1 AS (SELECT gene, arg_max(beta, (weight, -sigma)) AS coef, {cauchy('p', 'weight')} AS p FROM p0 JOIN weights USING (gene, sigma) GROUP BY 1)
SELECT * FROM (SELECT gene, round(coef, 6) AS coef, round(p, 6) AS p, round({bh('p', '', '')}, 6) AS fdr, CASE WHEN coef > 0 THEN 'Up' ELSE 'Down' END AS Direction FROM {ranked('p1', 'p', '', 'gene')}) WHERE fdr < 0.9""",
    "gene_index_fdr": f"{GATES}, {pairs(FDR)} SELECT gene, ct_index, round(fdr_gene, 6) AS fdr_gene, round(fdr_index, 6) AS fdr_index FROM pairs",
    "niche_level_fdr": f"{GATES}, {pairs(0.97)}, {niche_level(FDR)} SELECT gene, ct_index, ct_niche, round(p_niche, 6) AS p_niche, bandwidth_max, round(t, 6) AS t, round(coef, 6) AS coef, DirectionNiche, round(fdr_niche, 6) AS fdr_niche FROM nl",
    "hierarchical_fdr": f"""{GATES}, {pairs(FDR)}, {niche_level(FDR)}
SELECT gene, ct_index, ct_niche, bandwidth_max, round(coef, 6) AS coef, round(t, 6) AS t,
  CASE WHEN min(t) OVER (PARTITION BY gene) > 0 THEN 'Up' WHEN max(t) OVER (PARTITION BY gene) < 0 THEN 'Down' ELSE 'Both' END AS DirectionGene,
  CASE WHEN min(t) OVER (PARTITION BY gene, ct_index) > 0 THEN 'Up' WHEN max(t) OVER (PARTITION BY gene, ct_index) < 0 THEN 'Down' ELSE 'Both' END AS DirectionIndex,
  DirectionNiche, round(fdr_gene, 6) AS fdr_gene, round(fdr_index, 6) AS fdr_index, round(fdr_niche, 6) AS fdr_niche FROM nl JOIN pairs USING (gene, ct_index)""",
    "set_means": f"{NICHE}, {SETS}, {STAT} SELECT sigma, collection, geneset, ct_index, ct_niche, round(zbar, 6) AS zbar FROM zb",
    "gsea_competitive": f"{NICHE}, {SETS}, {STAT} SELECT sigma, geneset, ct_index, ct_niche, round(stat, 6) AS stat FROM stat",
    "gsea_self_contained": f"{NICHE}, {SETS}, {STAT} SELECT sigma, geneset, ct_index, ct_niche, round(self, 6) AS stat FROM stat",
    "gsea_cascade": f"""{NICHE}, {SETS}, {STAT}, {CASCADE}
SELECT * FROM (SELECT geneset, collection, size, ct_index, ct_niche, bandwidth_max, round(z, 6) AS z, CASE WHEN z > 0 THEN 'Up' ELSE 'Down' END AS Direction, round(fdr_geneset, 6) AS fdr_geneset, round(fdr_index, 6) AS fdr_index,
  round({bh('p', 'collection, geneset, ct_index', '')}, 6) AS fdr_niche FROM {ranked('l3', 'p', 'collection, geneset, ct_index', 'ct_niche')}) WHERE fdr_niche < 0.999""",
    "lambda_by_celltype": f"{NICHE} SELECT ct_index, round(median(t * t) / {0.6744897501960817**2}, 6) AS lambda FROM nw GROUP BY 1",
}
assert math.isclose(0.6744897501960817**2, 0.4549364231195728, rel_tol=1e-9)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [
        niche_padded, niche_merge, niche_merge_composed, self_niche_drop, detect_sigma, design_coefmap, design_random_columns, design_matrix_long, tested_columns,
        sample_condition_check, stratified_sample_sizes, cell_abundance_weights, nb_group_means, nb_loglik_fixed_psi, pearson_dispersion, pearson_residual_rho,
        gene_weights, response_wald, niche_score_z, cauchy_combine, bh_gene, bh_nested, celltype_fdr, patient_fdr, gene_index_fdr, niche_level_fdr, hierarchical_fdr,
        set_means, gsea_cascade, lambda_by_celltype,
    ]
    out = {"niche_density_diggle": _density(True, True), "niche_density_edge": _density(True, False), "niche_density_noedge": _density(False, False), "ls_matrix": q_ls_matrix, "size_factors": q_size_factors}
    out |= {f.__name__: f for f in own}
    out |= {"gsea_competitive": _set_stat("competitive"), "gsea_self_contained": _set_stat("self-contained")}
    return out | closed.queries()


def oracle_sql() -> dict[str, str]:
    return SQL | closed.oracle_sql()
