"""Wald inference per gene and within-gene combination of p-values (Cauchy or Brown)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import special
from . import nb
from .combine import settled
from .fit import Fit, _psum, dense

EPS = 1e-15
#: Bytes that a task may use for the dense arrays of a block of genes.
BLOCK_BYTES = 1 << 28


def cauchy(p: np.ndarray) -> float:
    p = np.clip(p[~np.isnan(p)], EPS, 1 - EPS)
    if not len(p):
        return float("nan")
    x = float(np.mean(1 / np.tan(p * np.pi)))
    return float(np.arctan(1 / x) / np.pi) if x > 1 else float(0.5 - np.arctan(x) / np.pi)


def brown(p: np.ndarray, r: np.ndarray) -> float:
    """Fisher's statistic of one-sided p against a scaled chi-square for correlation r (Kost and McDermott 2002)."""
    k = len(p)
    x = float(-2 * np.log(np.maximum(p, special_tiny)).sum())
    c = 3.263 * r + 0.710 * r**2 + 0.027 * r**3
    var = 4 * k + 2 * float(np.triu(c, 1).sum())
    mean = 2.0 * k
    scale, df = var / (2 * mean), 2 * mean**2 / var
    return float(special.pchisq_upper(np.array(x / scale), df))


special_tiny = 2.2250738585072014e-308


def block_size_of(cells: int, columns: int, budget: int = BLOCK_BYTES) -> int:
    """Genes whose counts, means, weights and covariances fit in the budget (one at least)."""
    return max(1, budget // (8 * (4 * cells + 3 * columns * columns)))


def covariances(w: np.ndarray, d: np.ndarray, sel: np.ndarray, pen: np.ndarray | None) -> np.ndarray:
    """`covariance` for each row of d; Gram matrices one by one, so that cells times columns squared is never held, inverses together."""
    x = w[:, sel] if pen is None else w
    gram = np.stack([x.T @ (x * r[:, None]) for r in d])
    if pen is None:
        return np.linalg.pinv(gram, hermitian=True)
    return np.linalg.pinv(gram + np.diag(pen), hermitian=True)[:, sel[:, None], sel]


def covariance(w: np.ndarray, d: np.ndarray, sel: np.ndarray, pen: np.ndarray | None) -> np.ndarray:
    """Of the tested coefficients: from the tested columns alone, or the block of the penalised inverse."""
    if pen is None:
        x = w[:, sel]
        return np.linalg.pinv(x.T @ (x * d[:, None]), hermitian=True)
    return np.linalg.pinv(w.T @ (w * d[:, None]) + np.diag(pen), hermitian=True)[np.ix_(sel, sel)]


def wald_gene(alpha: np.ndarray, psi: float, y: np.ndarray, w: np.ndarray, sel: np.ndarray, niche: np.ndarray, index: list[str], levels: list[str], pen: np.ndarray | None, df, fixed_cols: int, w_rc: np.ndarray | None, combine: str, v: np.ndarray | None = None) -> dict:
    """t, se, combined p of the gene and of each index type (up, down), patient se, log-likelihood and residuals."""
    mu = np.exp(np.clip(w @ alpha, -nb.ETA, nb.ETA))
    if v is None:
        v = covariance(w, 1 / (1 / mu + psi), sel, pen)
    scale = psi if pen is None else float(((y - mu) ** 2 / (mu + psi * mu**2)).sum() / max(len(y) - fixed_cols, 1))
    se = np.sqrt(scale * np.diag(v))
    t = alpha[sel] / se
    ref = None if pen is None else df
    if combine == "cauchy":
        two = np.minimum(1, 2 * np.minimum(special.pt(t, ref, True), special.pt(t, ref, False)))[niche]
        up = [cauchy(two)] + [cauchy(two[[i == c for i in index]]) for c in levels]
        down = up
    else:
        vc = v[np.ix_(niche, niche)]
        dev = np.sqrt(np.diag(vc))
        r = vc / np.outer(dev, dev)
        up, down = [], []
        for out, lower in ((up, False), (down, True)):
            x = special.pt(t, ref, lower)[niche]
            out.append(brown(x, r))
            for c in levels:
                k = np.array([i == c for i in index])
                out.append(brown(x[k], r[np.ix_(k, k)]))
    pat = None if w_rc is None else float(np.sqrt(scale * (w_rc @ v @ w_rc)))
    z = (y - mu) / np.sqrt(mu + psi * mu**2)
    return {"t": t, "se": se, "up": up, "down": down, "se_patient": pat, "loglik": nb.Counts(y).loglik(mu, psi), "z": z}


def abundance(fit: Fit) -> np.ndarray | None:
    """Weights of the tested columns in the patient contrast: shares of cells over types with a type:condition column."""
    terms = [fit.design.terms[i] for i in fit.sel]
    rc = np.array([t.type == "ResponseCellType" for t in terms])
    if not rc.any():
        return None
    own = {t.cell_type: i for i, t in enumerate(fit.design.terms) if t.type == "CellType"}
    n = np.array([(fit.w[:, own[t.ct_index]] != 0).sum() if k else 0 for t, k in zip(terms, rc, strict=True)], float)
    return n / n.sum()


def infer(fit: Fit, packed: DataFrame, combine: str = "cauchy", with_rho: bool = True, block_size: int | None = None) -> Fit:
    """Fill in wald, pcomb, patient and rho. Genes are independent, so neither partitions nor blocks can change a result.

    block_size: genes that a task holds as dense arrays and inverts together; by default what BLOCK_BYTES allow.
    """
    if block_size is not None and block_size < 1:
        raise ValueError("block_size must be at least 1")
    if combine not in ("cauchy", "brown"):
        raise ValueError("combine must be cauchy or brown")
    spark, sel = packed.sparkSession, fit.sel
    niche = fit.design.niche_tested[sel]
    terms = [fit.design.terms[i] for i in sel]
    index = [t.ct_index for t, k in zip(terms, niche, strict=True) if k]
    levels = list(dict.fromkeys(index))
    fixed_cols = sum(t.re_group is None for t in fit.design.terms)
    w_rc = abundance(fit)
    bc = spark.sparkContext.broadcast((fit.ids, fit.w, fit.penalty))
    df = fit.df
    src = packed.join(fit.genes, "gene").select("gene", "cells", "n", "alpha", "psi")

    def one(batches):
        ids, w, pen = bc.value
        for b in batches:
            alpha = b.column(3).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1) if b.num_rows else None
            names, psi = b.column(0).to_pylist(), b.column(4).to_numpy()
            size = block_size or block_size_of(len(ids), w.shape[1] if pen is not None else len(sel))
            for i in range(0, b.num_rows, size):
                own = range(i, min(i + size, b.num_rows))
                mu = np.exp(np.clip(alpha[own.start : own.stop] @ w.T, -nb.ETA, nb.ETA))
                v = covariances(w, 1 / (1 / mu + psi[own.start : own.stop, None]), sel, pen)
                for g in own:
                    y = dense(b.column(1)[g].values.to_numpy(zero_copy_only=False), b.column(2)[g].values.to_numpy(zero_copy_only=False), ids)
                    yield names[g], alpha[g], wald_gene(alpha[g], float(psi[g]), y, w, sel, niche, index, levels, pen, df, fixed_cols, w_rc, combine, v[g - i])

    def run(batches):
        rows = [(n, a[sel], r["t"], r["se"], r["up"], r["down"], r["se_patient"], r["loglik"], None if w_rc is None else float(a[sel] @ w_rc)) for n, a, r in one(batches)]
        v = pa.list_(pa.float64())
        kinds = [pa.string(), v, v, v, v, v, pa.float64(), pa.float64(), pa.float64()]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], ["gene", "coef", "t", "se", "up", "down", "se_patient", "loglik", "beta"])

    res = src.mapInArrow(run, "gene string, coef array<double>, t array<double>, se array<double>, up array<double>, down array<double>, se_patient double, loglik double, beta double")
    res = settled(res)
    dfs = [None] * len(sel) if df is None else [float(df)] * len(sel) if np.ndim(df) == 0 else [float(x) for x in df]
    cols = spark.createDataFrame([(k, int(i), t.covariate, t.type, t.ct_index, t.ct_niche, dfs[k]) for k, (i, t) in enumerate(zip(sel, terms, strict=True))], "k int, pos int, covariate string, type string, ct_index string, ct_niche string, df double")
    long = res.select("gene", F.posexplode(F.arrays_zip("coef", "t", "se")).alias("k", "v")).select("gene", "k", "v.coef", "v.t", "v.se")
    fit.wald = long.join(F.broadcast(cols), "k").select(F.lit(fit.sigma).alias("sigma"), "gene", "pos", "covariate", "type", "ct_index", "ct_niche", "coef", "se", "t", "df")
    names = spark.createDataFrame([(0, "Gene", None)] + [(i + 1, "Index", c) for i, c in enumerate(levels)], "k int, level string, ct_index string")
    comb = res.select("gene", F.posexplode(F.arrays_zip("up", "down")).alias("k", "v")).join(F.broadcast(names), "k")
    fit.pcomb = comb.select(F.lit(fit.sigma).alias("sigma"), "gene", "level", "ct_index", F.col("v.up").alias("p_pos"), F.col("v.down").alias("p_neg"))
    rc = [dfs[k] for k, t in enumerate(terms) if t.type == "ResponseCellType"]
    pat_df = None if not rc or rc[0] is None else float(np.median(rc))
    fit.patient = res.select(F.lit(fit.sigma).alias("sigma"), "gene", "beta", "se_patient", F.lit(pat_df).cast("double").alias("df")) if w_rc is not None else None
    fit.genes = fit.genes.drop("loglik").join(res.select("gene", "loglik"), "gene")
    fit.two_sided = combine == "cauchy"
    if with_rho:
        fit.rho = residual_rho(fit, packed)
    return fit


def residual_rho(fit: Fit, packed: DataFrame, genes: DataFrame | None = None) -> float:
    """Mean correlation of Pearson residuals between genes, from per-cell sums of standardised residuals."""
    bc = packed.sparkSession.sparkContext.broadcast((fit.ids, fit.w))
    src = packed.join(fit.genes.select("gene", "alpha", "psi"), "gene").select("cells", "n", "alpha", "psi", "gene")
    if genes is not None:
        src = src.join(genes, "gene", "left_semi")
    src = src.select("cells", "n", "alpha", "psi")

    def sums(batches):
        ids, w = bc.value
        total = np.zeros(len(ids) + 1)
        for b in batches:
            if not b.num_rows:
                continue
            alpha = b.column(2).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            for g, psi in enumerate(b.column(3).to_pylist()):
                y = dense(b.column(0)[g].values.to_numpy(zero_copy_only=False), b.column(1)[g].values.to_numpy(zero_copy_only=False), ids)
                mu = np.exp(np.clip(w @ alpha[g], -nb.ETA, nb.ETA))
                z = (y - mu) / np.sqrt(mu + psi * mu**2)
                sd = z.std(ddof=1)
                if sd > 0:
                    total[:-1] += (z - z.mean()) / sd
                    total[-1] += 1
        return total

    t = _psum(src, sums, len(fit.ids) + 1, packed.sparkSession)
    return mean_correlation(t[:-1], int(t[-1]))


def mean_correlation(s: np.ndarray, p: int) -> float:
    """Mean off-diagonal correlation of p standardised variables with per-observation sums s."""
    return float((np.sum(s * s) / (len(s) - 1) - p) / (p * (p - 1))) if p >= 2 else 0.0
