"""The public interface: fit, test, gene sets, the whole pipeline, and stored results."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import fdr as layers
from ..operators import gsea
from ..operators.combine import combine_bandwidths, relative_weights, settled, union
from ..operators.design import Design, build_design
from ..operators.fit import Fit, fit_design, pack_counts
from ..operators.inference import infer, residual_rho
from ..operators.niches import CUTOFF, SIGMAS, build_niches, detect_sigmas
from . import validate

BACKENDS = ("auto", "cpu")


@dataclass
class Results:
    """Fits of all bandwidths and the three result layers."""

    fits: list[Fit]
    packed: DataFrame
    combine: str | None = None
    fdr: float | None = None
    weights: DataFrame | None = None
    pcomb: DataFrame | None = None
    tables: dict[str, DataFrame] = field(default_factory=dict)

    @property
    def bandwidths(self) -> list[float]:
        return [f.sigma for f in self.fits]

    @property
    def mode(self) -> str:
        return self.fits[0].mode

    def results(self, kind: str = "niche") -> DataFrame:
        """A result layer: niche, celltype or patient."""
        if kind not in ("niche", "celltype", "patient"):
            raise ValueError("kind must be niche, celltype or patient")
        if kind not in self.tables:
            raise ValueError("no results yet: run test() first")
        return self.tables[kind]

    def __getitem__(self, name: str):
        """A slot by name: fits, weights, pcomb, tables, ..."""
        return getattr(self, name)

    def wald(self) -> DataFrame:
        return union([f.wald for f in self.fits])

    def loglik(self) -> DataFrame:
        return union([f.genes.select(F.lit(f.sigma).alias("sigma"), "gene", "loglik") for f in self.fits])

    def __repr__(self) -> str:
        done = ", ".join(self.tables) or "untested"
        return f"Results({'niche-only' if self.mode == 'niche' else 'condition'} mode, bandwidths {', '.join(f'{s:g}' for s in self.bandwidths)}; {done})"


def _backend(backend: str) -> None:
    if backend not in BACKENDS:
        raise ValueError(f"backend must be one of {', '.join(BACKENDS)}; there is no GPU path")


def niche_design(cells: DataFrame, niches: DataFrame, sigma: float, **how) -> Design:
    """The validated design of one bandwidth: its matrix, tags, and random-effect groups."""
    design = build_design(cells, niches, sigma, **how)
    if how.get("random", "none") != "none":
        validate.check_samples(cells, how.get("condition"), how.get("covariates", ()))
    return design


def fit(cells: DataFrame, counts: DataFrame, niches: DataFrame, condition: str | None = None, index=None, niche=None, covariates=(), sigma=None, random: str = "none", niche_groups: DataFrame | None = None, designs: list[Design] | None = None, backend: str = "auto", winsor: float | None = 4.0, **how) -> Results:
    """One fit per bandwidth (all stored ones by default). designs: ready-made designs instead of built ones.

    winsor: robust deviations from a column's median to which coefficients are drawn in; None leaves them.
    """
    _backend(backend)
    validate.check_cells(cells)
    validate.check_counts(counts)
    validate.check_prop(how.get("re_prop", 1.0)) if random != "none" else None
    if sigma is None and designs is None:
        sigma = [r[0] for r in detect_sigmas(niches).collect()]
        if not sigma:
            raise ValueError("no niches found; build them first")
    packed = pack_counts(counts.join(cells.select("cell_id"), "cell_id", "left_semi"), counts.sparkSession.sparkContext.defaultParallelism).persist()
    if designs is None:
        sigma = [sigma] if isinstance(sigma, int | float) else list(sigma)
        designs = [niche_design(cells, niches, float(s), condition=condition, index=index, niche=niche, covariates=covariates, random=random, niche_groups=niche_groups) for s in sigma]
    return Results([fit_design(d, packed, cells, random=random, winsor=winsor, **how) for d in designs], packed)


def test(res: Results, fdr: float = 0.05, weight_thresh: float = 0.1, combine: str = "cauchy", backend: str = "auto", block_size: int | None = None) -> Results:
    """Inference (again if `combine` changed), combination over bandwidths, and the three layers."""
    _backend(backend)
    validate.check_fdr(fdr)
    if res.combine != combine or any(f.wald is None for f in res.fits):
        for f in res.fits:
            infer(f, res.packed, combine, block_size=block_size)
        res.combine = combine
    two = res.fits[0].two_sided
    res.weights = settled(relative_weights(res.loglik(), "gene", weight_thresh))
    p = union([f.pcomb for f in res.fits]).withColumn("ct_index", F.coalesce("ct_index", F.lit("")))
    p = combine_bandwidths(p, res.weights, ["gene", "level", "ct_index"], ["p_pos", "p_neg"])
    res.pcomb = settled(p.withColumn("ct_index", F.when(F.col("level") == "Index", F.col("ct_index"))))
    wald = res.wald()
    res.tables = {"niche": layers.hierarchical_fdr(res.pcomb, layers.niche_records(wald, res.mode), res.weights, fdr, two)}
    spark = res.packed.sparkSession
    if res.mode == "condition":
        res.tables["celltype"] = layers.celltype_fdr(layers.celltype_pvalues(wald, res.weights), fdr)
        res.tables["patient"] = layers.patient_fdr(layers.patient_pvalues(union([f.patient for f in res.fits]), res.weights), fdr)
    else:
        res.tables["celltype"] = spark.createDataFrame([], "gene string, ct_index string, p double, fdr_gene double, fdr_celltype double")
        res.tables["patient"] = spark.createDataFrame([], "gene string, coef double, p double, fdr double, Direction string")
    res.fdr = fdr
    return res


def run(cells: DataFrame, counts: DataFrame, condition: str | None = None, sigma=SIGMAS, niches: DataFrame | None = None, edge: bool = True, diggle: bool = True, cutoff_sigmas: float | None = CUTOFF, fdr: float = 0.05, weight_thresh: float = 0.1, combine: str = "cauchy", **how) -> Results:
    """Niches (all of them if any bandwidth is missing), fit and test."""
    sigma = [float(s) for s in ([sigma] if isinstance(sigma, int | float) else sigma)]
    have = set() if niches is None else {r[0] for r in detect_sigmas(niches).collect()}
    if set(sigma) - have:
        niches = build_niches(cells, sigma, edge, diggle, cutoff_sigmas).persist()
    return test(fit(cells, counts, niches, condition, sigma=sigma, **how), fdr, weight_thresh, combine)


def gene_sets(res: Results, genesets: DataFrame, kind: str = "niche", test: str = "competitive", fdr: float = 0.05, min_size: int = 5, max_size: int = 500, rho=None, rho_genes: int = 2000, seed: int = 1, backend: str = "auto") -> tuple[DataFrame, dict[float, float]]:
    """(table, rho used per bandwidth). rho: a number or one per bandwidth; else the stored one; else estimated on rho_genes genes."""
    _backend(backend)
    validate.check_fdr(fdr)
    if any(f.wald is None for f in res.fits):
        raise ValueError("no statistics yet: run test() first")
    if rho is not None:
        values = [float(rho)] * len(res.fits) if np.ndim(rho) == 0 else [float(x) for x in rho]
        if len(values) != len(res.fits):
            raise ValueError("rho must be one number or one per bandwidth")
    else:
        chosen = res.packed.select("gene").orderBy(F.xxhash64(F.lit(seed), "gene")).limit(rho_genes)
        values = [f.rho if f.rho is not None and np.isfinite(f.rho) else residual_rho(f, res.packed, chosen) for f in res.fits]
    spark = res.packed.sparkSession
    table = spark.createDataFrame(list(zip(res.bandwidths, values, strict=True)), "sigma double, rho double")
    out = gsea.gene_set_test(res.wald(), res.loglik(), genesets, table, res.mode, kind, test, fdr, min_size, max_size)
    return out, dict(zip(res.bandwidths, values, strict=True))


def join_fits(*results: Results) -> Results:
    """Single-bandwidth results of the same genes put together; test() them again."""
    fits = sorted((f for r in results for f in r.fits), key=lambda f: f.sigma)
    if len({f.sigma for f in fits}) < len(fits):
        raise ValueError("a bandwidth occurs twice")
    return Results(fits, results[0].packed, results[0].combine if len({r.combine for r in results}) == 1 else None)


#: Columns of stored tables and the values that older tables lack.
STORED = {
    "wald": {"df": None},
    "fit_gene": {"se_patient": None},
    "fit_bandwidth": {"mode": "condition", "two_sided": False, "rho": None, "penalty": None, "tau2": None},
}


def migrate(stored: DataFrame, table: str) -> DataFrame:
    """A stored table with the columns that its version lacks, at their defaults."""
    types = {"mode": "string", "two_sided": "boolean", "penalty": "array<double>", "tau2": "map<string,double>"}
    new = {c: F.lit(v).cast(types.get(c, "double")) for c, v in STORED[table].items() if c not in stored.columns}
    return stored.withColumns(new) if new else stored


def save(res: Results, path: str) -> None:
    """Write wald, loglik, weights, bandwidths and layers as Parquet."""
    spark = res.packed.sparkSession
    res.wald().write.mode("overwrite").parquet(f"{path}/wald")
    res.loglik().write.mode("overwrite").parquet(f"{path}/fit_gene")
    rows = [(f.sigma, f.mode, f.two_sided, f.rho, None if f.penalty is None else f.penalty.tolist(), f.tau2 or None) for f in res.fits]
    spark.createDataFrame(rows, "sigma double, mode string, two_sided boolean, rho double, penalty array<double>, tau2 map<string,double>").write.mode("overwrite").parquet(f"{path}/fit_bandwidth")
    for k, t in res.tables.items():
        t.write.mode("overwrite").parquet(f"{path}/{k}")


def load(spark, path: str, table: str) -> DataFrame:
    df = spark.read.parquet(f"{path}/{table}")
    return migrate(df, table) if table in STORED else df
