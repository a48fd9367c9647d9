"""Fitting: per-gene NB regression, gene-parallel, with moderated dispersions and random effects.

Counts are gathered once per gene (sparse arrays), the design is broadcast (its size is checked) and
genes are fitted in Arrow batches. Genes meet only in sums: the shared dispersion curve, the mean
working weight per cell, and the squared random effects; each is added up per partition first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import nb
from .combine import settled
from .design import Design

TAU2_RANGE = (1e-8, 1e4)


@dataclass
class Fit:
    """One bandwidth: design, coefficients and what inference needs."""

    sigma: float
    mode: str
    design: Design
    ids: np.ndarray
    w: np.ndarray
    genes: DataFrame  # gene, alpha, psi, loglik
    penalty: np.ndarray | None = None
    tau2: dict[str, float] = field(default_factory=dict)
    df: np.ndarray | float | None = None
    wald: DataFrame | None = None
    pcomb: DataFrame | None = None
    patient: DataFrame | None = None
    rho: float | None = None
    two_sided: bool = True

    def __repr__(self) -> str:
        kind = "niche-only" if self.mode == "niche" else "condition"
        return f"Fit(sigma={self.sigma:g}, {kind} mode, {len(self.ids)} cells, {len(self.design.terms)} columns{', random effects' if self.penalty is not None else ''}{'' if self.wald is None else ', tested'})"

    def __getitem__(self, name: str):
        """A slot by name: design, genes, wald, ..."""
        return getattr(self, name)

    @property
    def sel(self) -> np.ndarray:
        return np.flatnonzero(self.design.tested)


def pack_counts(counts: DataFrame, partitions: int | None = None) -> DataFrame:
    """(gene, cells, n): one row per gene with the cells that have counts, partitioned by gene."""
    c = counts.where("n <> 0").groupBy("gene", "cell_id").agg(F.sum("n").cast("double").alias("n"))
    c = c.groupBy("gene").agg(F.collect_list(F.struct("cell_id", "n")).alias("r"))
    silent = counts.select("gene").distinct()
    out = silent.join(c, "gene", "left").select("gene", F.coalesce(F.transform("r", lambda x: x["cell_id"]), F.array().cast("array<bigint>")).alias("cells"), F.coalesce(F.transform("r", lambda x: x["n"]), F.array().cast("array<double>")).alias("n"))
    return out.repartition(partitions, "gene") if partitions else out


def dense(cells: np.ndarray, n: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Counts of one gene for the cells `ids` (sorted)."""
    y = np.zeros(len(ids))
    at = np.minimum(np.searchsorted(ids, cells), len(ids) - 1)
    ok = ids[at] == cells
    np.add.at(y, at[ok], n[ok])
    return y


def each_gene(batches: Iterator[pa.RecordBatch], ids: np.ndarray):
    for b in batches:
        genes = b.column(0).to_pylist()
        cells, n = b.column(1), b.column(2)
        for g, name in enumerate(genes):
            yield name, dense(cells[g].values.to_numpy(zero_copy_only=False), n[g].values.to_numpy(zero_copy_only=False), ids), b, g


def _psum(df: DataFrame, fn, size: int, spark) -> np.ndarray:
    """Sum over partitions of the vectors that fn makes of a partition's batches (size is bounded by the design)."""

    def run(batches):
        yield pa.RecordBatch.from_arrays([pa.array([fn(batches)], pa.list_(pa.float64()))], ["v"])

    total = np.zeros(size)
    for r in df.mapInArrow(run, "v array<double>").toLocalIterator():
        total += np.array(r.v)
    return total


def fit_nb(packed: DataFrame, ids: np.ndarray, w: np.ndarray, pen: np.ndarray, idx: np.ndarray | None = None, winsor: float | None = None, prior_genes: float = nb.PRIOR_GENES, rounds: int = 1) -> DataFrame:
    """(gene, alpha, psi, loglik) of every gene; idx: cells to use (all by default)."""
    spark = packed.sparkSession
    own_ids, own_w = (ids, w) if idx is None else (ids[idx], w[idx])
    bc = spark.sparkContext.broadcast((own_ids, own_w, np.asarray(pen, float)))

    def curves(batches):
        i, x, p = bc.value
        x = nb.blocks(x)
        out = [(name, *one_curve(y, x, p)) for name, y, _, _ in each_gene(batches, i)]
        v = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], kind) for k, kind in enumerate((pa.string(), v, v))], ["gene", "curve", "alpha"])

    def one_curve(y, x, p):
        a = nb.irls(y, x, 0.1, p)
        for _ in range(rounds):
            mu = np.exp(np.clip(x @ a, -nb.ETA, nb.ETA))
            a = nb.irls(y, x, nb.first_dispersion(y, mu), p, a)
        mu = np.exp(np.clip(x @ a, -nb.ETA, nb.ETA))
        return nb.profile(y, x, mu, p), a

    # curves and coefficients of the first pass are kept, a few hundred bytes a gene
    first = packed.mapInArrow(curves, "gene string, curve array<double>, alpha array<double>").persist()
    total = {r["pos"]: r["v"] for r in first.select(F.posexplode("curve").alias("pos", "v")).groupBy("pos").agg(F.avg("v").alias("v")).collect()}  # a row for each point of the grid
    common = prior_genes * np.array([total.get(k, 0.0) for k in range(len(nb.GRID))])

    def final(batches):
        i, x, p = bc.value
        x = nb.blocks(x)
        out = []
        for name, y, b, g in each_gene(batches, i):
            psi = nb.peak(b.column(3)[g].values.to_numpy(zero_copy_only=False) + common)
            a = nb.irls(y, x, psi, p, b.column(4)[g].values.to_numpy(zero_copy_only=False))
            mu = np.exp(np.clip(x @ a, -nb.ETA, nb.ETA))
            out.append((name, a, psi, nb.Counts(y).loglik(mu, psi)))
        yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.list_(pa.float64())), pa.array([o[2] for o in out], pa.float64()), pa.array([o[3] for o in out], pa.float64())], ["gene", "alpha", "psi", "loglik"])

    fitted = packed.join(first, "gene").select("gene", "cells", "n", "curve", "alpha").mapInArrow(final, "gene string, alpha array<double>, psi double, loglik double")
    return winsorise(fitted, winsor) if winsor else fitted


def winsorise(genes: DataFrame, at: float) -> DataFrame:
    """genes with every coefficient drawn in to `at` robust deviations (scaled median absolute ones) from its column's median."""
    rows = genes.persist()
    long = rows.select(F.posexplode("alpha").alias("pos", "a"))
    mid = long.groupBy("pos").agg(F.median("a").alias("mid"))
    dev = long.join(F.broadcast(mid), "pos").groupBy("pos", "mid").agg((1.4826 * F.median(F.abs(F.col("a") - F.col("mid")))).alias("dev"))  # a row for each column of the design
    edges = dev.where("dev > 0").agg(F.map_from_entries(F.collect_list(F.struct("pos", F.struct((F.col("mid") - at * F.col("dev")).alias("lo"), (F.col("mid") + at * F.col("dev")).alias("hi"))))).alias("__edges"))
    drawn = F.transform("alpha", lambda a, j: F.coalesce(F.greatest(F.element_at("__edges", j)["lo"], F.least(F.element_at("__edges", j)["hi"], a)), a))
    return rows.join(F.broadcast(edges)).withColumn("alpha", drawn).drop("__edges")


def rep_weights(packed: DataFrame, genes: DataFrame, ids: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Mean over genes of the working weight mu / (1 + psi mu) of every cell."""
    bc = packed.sparkSession.sparkContext.broadcast(w)

    def weights(batches):
        total = np.zeros(len(bc.value) + 1)
        for b in batches:
            a = b.column(0).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for k, psi in enumerate(b.column(1).to_pylist()):
                mu = np.exp(np.clip(bc.value @ a[k], -nb.ETA, nb.ETA))
                total[:-1] += mu / (1 + psi * mu)
            total[-1] += b.num_rows
        return total

    t = _psum(genes.select("alpha", "psi"), weights, len(ids) + 1, packed.sparkSession)
    return t[:-1] / max(t[-1], 1.0)


def stratified_cells(cells: DataFrame, prop: float, least: int = 100, seed: int = 1) -> DataFrame:
    """A sample of cells with min(n, max(ceil(prop n), least)) of every sample and type."""
    if prop >= 1:
        return cells.select("cell_id")
    key = ["sample_id", "cell_type"]
    r = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64(F.lit(seed), "cell_id"), "cell_id"))
    n = F.count("*").over(W.partitionBy(*key))
    return cells.withColumns({"__r": r, "__n": n}).where(F.col("__r") <= F.least(F.col("__n"), F.greatest(F.ceil(F.lit(prop) * F.col("__n")), F.lit(least)))).select("cell_id")


def variance_information(a: np.ndarray, minv: np.ndarray, pen: np.ndarray, groups: list[np.ndarray], n: int) -> np.ndarray:
    """Expected REML information of (phi, tau2 of each group) at phi = 1, from p by p blocks alone."""
    k = len(groups)
    info = np.zeros((k + 1, k + 1))
    ml = minv * pen[None, :]
    info[0, 0] = 0.5 * (n - len(a) + np.sum(ml * ml.T))
    mid = ml @ minv
    for i, ci in enumerate(groups):
        ai = a[:, ci]
        for j in range(i + 1):
            cj = groups[j]
            b = a[np.ix_(ci, cj)] - ai.T @ (minv @ a[:, cj])
            info[i + 1, j + 1] = info[j + 1, i + 1] = 0.5 * np.sum(b * b)
        trace_b = np.trace(a[np.ix_(ci, ci)]) - np.sum((minv @ ai) * ai)
        info[0, i + 1] = info[i + 1, 0] = 0.5 * (trace_b - np.sum((mid @ ai) * ai))
    return info


def satterthwaite(a: np.ndarray, minv: np.ndarray, pen: np.ndarray, groups: list[np.ndarray], tau2: list[float], tested: np.ndarray, n: int) -> np.ndarray:
    """Degrees of freedom of every tested column, the same for all genes."""
    cov = np.linalg.pinv(variance_information(a, minv, pen, groups, n))
    v = np.diag(minv)[tested]
    grad = np.column_stack([v, *[(pen[c[0]] / t) * (minv[np.ix_(tested, c)] ** 2).sum(axis=1) for c, t in zip(groups, tau2, strict=True)]])
    return np.clip(2 * v**2 / np.einsum("ij,jk,ik->i", grad, cov, grad), 1, n)


def between_df(mode: str, groups: list[str | None], n_cells: int) -> float:
    """Degrees of freedom by counting: samples, or cells where niches vary within samples."""
    samples = sum(g == "SampleInt" for g in groups)
    if mode == "niche":
        return float(max(samples - 1, 1)) if "SampleSlope" in groups else float(max(n_cells - sum(g is None for g in groups), 1))
    return float(max(samples - 2, 1))


def fit_design(design: Design, packed: DataFrame, cells: DataFrame | None = None, random: str = "none", lambda_a: float = 0.0, winsor: float | None = None, re_maxit: int = 10, re_tol: float = 1e-3, tau2_init: float = 1.0, re_prop: float = 1.0, re_maxit_psi: int = 1, re_min_cells: int = 100, df_method: str = "satterthwaite", verbose: bool = False) -> Fit:
    """Fit one bandwidth. With random effects: penalised fits and variance updates in turn, then a full fit.

    re_maxit_psi: moment updates of a gene's dispersion in the fits between variance updates.
    """
    if re_maxit_psi < 1:
        raise ValueError("re_maxit_psi must be at least 1")
    if df_method not in ("satterthwaite", "between"):
        raise ValueError("df_method must be satterthwaite or between")
    ids, w = design.matrix()
    p = len(design.terms)
    labels = [t.re_group for t in design.terms]
    base = np.array([0.0 if g else lambda_a for g in labels])
    if random == "none":
        genes = settled(fit_nb(packed, ids, w, base, winsor=winsor))
        return Fit(design.sigma, design.mode, design, ids, w, genes)
    names = list(dict.fromkeys(g for g in labels if g))
    groups = [np.array([i for i, g in enumerate(labels) if g == n]) for n in names]
    tau2 = dict.fromkeys(names, float(tau2_init))
    idx = None
    if re_prop < 1:
        chosen = np.sort(stratified_cells(cells, re_prop, re_min_cells).toArrow().column(0).to_numpy())
        idx = np.isin(ids, chosen)
    own = w if idx is None else w[idx]

    def penalty() -> np.ndarray:
        pen = base.copy()
        for n, g in zip(names, groups, strict=True):
            pen[g] = 1 / tau2[n]
        return pen

    for it in range(re_maxit):
        pen = penalty()
        genes = fit_nb(packed, ids, w, pen, idx=idx, winsor=winsor, rounds=re_maxit_psi).persist()
        wbar = rep_weights(packed, genes, ids if idx is None else ids[idx], own)
        minv = np.linalg.pinv(own.T @ (own * wbar[:, None]) + np.diag(pen), hermitian=True)
        sums = genes.select(*[sum((F.col("alpha")[int(j)] * F.col("alpha")[int(j)] for j in g), F.lit(0.0)).alias(n) for n, g in zip(names, groups, strict=True)]).agg(F.count("*").alias("__g"), *[F.sum(n).alias(n) for n in names]).first()
        genes.unpersist()
        new = {}
        for n, g in zip(names, groups, strict=True):
            edf = max(len(g) - np.trace(minv[np.ix_(g, g)]) / tau2[n], 1e-6)
            new[n] = float(np.clip(sums[n] / (sums["__g"] * edf), *TAU2_RANGE))
        if verbose:
            print(f"sigma {design.sigma:g}, round {it + 1}: {new}")
        if max(abs(np.log(new[n]) - np.log(tau2[n])) for n in names) < re_tol:
            break  # the values of the last fit stay
        tau2 = new
    pen = penalty()
    genes = settled(fit_nb(packed, ids, w, pen, winsor=winsor))
    if df_method == "between":
        df: np.ndarray | float = between_df(design.mode, labels, len(ids))
    else:
        wbar = rep_weights(packed, genes, ids, w)
        a = w.T @ (w * wbar[:, None])
        df = satterthwaite(a, np.linalg.pinv(a + np.diag(pen), hermitian=True), pen, groups, [tau2[n] for n in names], np.flatnonzero(design.tested), len(ids))
    return Fit(design.sigma, design.mode, design, ids, w, genes, penalty=pen, tau2=tau2, df=df)
