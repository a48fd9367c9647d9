"""Pieces of SQL that the registered queries' twins are made of."""

from __future__ import annotations

from ..operators.combine import union  # noqa: F401

CELLS = """cells AS (SELECT c_custkey AS cell_id, 'S' || CAST(c_nationkey % 6 AS VARCHAR) AS sample_id, c_mktsegment AS cell_type,
  CAST((c_custkey * 7919) % 499 AS DOUBLE) AS x, CAST((c_custkey * 104729) % 503 AS DOUBLE) AS y,
  CASE WHEN c_nationkey % 6 % 2 = 1 THEN 'Treated' ELSE 'Control' END AS condition, CAST((c_custkey * 31) % 17 + 1 AS DOUBLE) AS area FROM customer)"""
COUNTS = """counts AS (SELECT p_brand AS gene, o_custkey AS cell_id, count(*) AS n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY 1, 2)"""


def erf(x: str) -> str:
    """erf by its series of positive terms."""
    s = f"list_sum([exp(n * ln(2 * ({x}) * ({x})) + 0.5 * ln(pi()) - (n + 1) * ln(2.0) - lgamma(n + 1.5)) for n in range(0, 120)])"
    return f"(CASE WHEN abs({x}) < 1e-12 THEN 0.0 WHEN abs({x}) > 5.9 THEN sign({x}) ELSE 2 / sqrt(pi()) * exp(-({x}) * ({x})) * ({x}) * {s} END)"


def erfc(x: str) -> str:
    """1 - erf for x >= 0, by its continued fraction where the difference would lose digits."""
    tail = f"exp(-({x}) * ({x})) / sqrt(pi()) / list_reduce(list_prepend(({x})::DOUBLE, [n / 2 for n in range(80, 0, -1)]), lambda f, k: ({x}) + k / f)"
    return f"(CASE WHEN ({x}) < 2 THEN 1 - {erf(x)} ELSE {tail} END)"


def mass(v: str, lo: str, hi: str, s: str) -> str:
    return f"0.5 * ({erf(f'({hi} - {v}) / ({s} * sqrt(2.0))')} - {erf(f'({lo} - {v}) / ({s} * sqrt(2.0))')})"


def two_sided(t: str) -> str:
    return erfc(f"abs({t}) / sqrt(2.0)")


def cauchy(p: str, w: str = "1.0") -> str:
    x = f"(sum(CASE WHEN {w} > 0 THEN {w} / tan({p} * pi()) END) / sum({w}))"
    return f"CASE WHEN {x} > 1 THEN atan(1 / {x}) / pi() ELSE 0.5 - atan({x}) / pi() END"


def bh(p: str, family: str, ties: str, times: float = 1.0) -> str:
    """(CTE body pieces) an adjusted p as an expression over a table that has __r and __n."""
    part = f"PARTITION BY {family} " if family else ""
    return f"least(1.0, least(1.0, min({p} * __n / __r) OVER ({part}ORDER BY __r DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)) * {times})"


def ranked(src: str, p: str, family: str, ties: str) -> str:
    part = f"PARTITION BY {family}" if family else ""
    return f"(SELECT *, row_number() OVER ({part} ORDER BY {p}, {ties}) AS __r, count({p}) OVER ({part}) AS __n FROM {src})"


CLAMPED = "greatest(least({0}, 1 - 1e-15), 1e-15)"


def upper(t: str) -> str:
    """Upper tail of the normal."""
    two = erfc(f"abs({t}) / sqrt(2.0)")
    return f"(CASE WHEN ({t}) > 0 THEN 0.5 * {two} ELSE 1 - 0.5 * {two} END)"


def chi_upper(x: str, df: str) -> str:
    """Upper tail of chi-square, by the series of the lower incomplete gamma function."""
    a, y = f"(({df}) / 2)", f"(({x}) / 2)"
    return f"(CASE WHEN {y} > 150 THEN 0.0 WHEN {y} <= 0 THEN 1.0 ELSE 1 - list_sum([exp({a} * ln({y}) - {y} + n * ln({y}) - lgamma({a} + n + 1)) for n in range(0, 400)]) END)"


def gates() -> str:
    """np, g1, i1, g2, i2, gq: evidence of a table nw of niche statistics under weights, and the genes' adjusted values."""
    return f"""np AS (SELECT *, {CLAMPED.format('least(1.0, ' + two_sided('t') + ')')} AS p, 0.5 * {two_sided('t')} AS p1 FROM nw),
g1 AS (SELECT gene, sigma, {cauchy('p')} AS p FROM np GROUP BY 1, 2),
i1 AS (SELECT gene, sigma, ct_index, {cauchy('p')} AS p FROM np GROUP BY 1, 2, 3),
g2 AS (SELECT gene, {cauchy('p', 'weight')} AS p FROM g1 JOIN weights USING (gene, sigma) GROUP BY 1),
i2 AS (SELECT gene, ct_index, {cauchy('p', 'weight')} AS p FROM i1 JOIN weights USING (gene, sigma) GROUP BY 1, 2),
gq AS (SELECT gene, {bh('p', '', 'gene')} AS fdr_gene FROM {ranked('g2', 'p', '', 'gene')})"""


def pairs(fdr: float) -> str:
    return f"""iq0 AS (SELECT i2.*, fdr_gene FROM i2 JOIN gq USING (gene) WHERE fdr_gene <= {fdr}),
pairs AS (SELECT * FROM (SELECT gene, ct_index, fdr_gene, {bh('p', 'gene', 'ct_index')} AS fdr_index FROM {ranked('iq0', 'p', 'gene', 'ct_index')}) WHERE fdr_index <= {fdr})"""


def niche_level(fdr: float) -> str:
    return f"""nl0 AS (SELECT gene, ct_index, ct_niche, {cauchy('p1', 'weight')} AS p_niche, arg_min(sigma, (p1, sigma)) AS bandwidth_max, arg_min(t, (p1, sigma)) AS t, arg_min(coef, (p1, sigma)) AS coef
  FROM np JOIN weights USING (gene, sigma) SEMI JOIN pairs USING (gene, ct_index) GROUP BY 1, 2, 3),
nl AS (SELECT * FROM (SELECT gene, ct_index, ct_niche, p_niche, bandwidth_max, t, coef, CASE WHEN t > 0 THEN 'Up' ELSE 'Down' END AS DirectionNiche, {bh('p_niche', 'gene, ct_index', 'ct_niche', 2.0)} AS fdr_niche
  FROM {ranked('nl0', 'p_niche', 'gene, ct_index', 'ct_niche')}) WHERE fdr_niche <= {fdr})"""


DIRECTIONS = """CASE WHEN min(t) OVER (PARTITION BY gene) > 0 THEN 'Up' WHEN max(t) OVER (PARTITION BY gene) < 0 THEN 'Down' ELSE 'Both' END AS DirectionGene,
  CASE WHEN min(t) OVER (PARTITION BY gene, ct_index) > 0 THEN 'Up' WHEN max(t) OVER (PARTITION BY gene, ct_index) < 0 THEN 'Down' ELSE 'Both' END AS DirectionIndex"""
