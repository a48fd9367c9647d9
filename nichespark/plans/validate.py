"""Checks that fail rather than drop rows."""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def check_cells(cells: DataFrame, required=("cell_id", "sample_id", "cell_type")) -> None:
    missing = [c for c in required if c not in cells.columns]
    if missing:
        raise ValueError(f"columns not found in cells: {', '.join(missing)}")


def check_counts(counts: DataFrame, column: str = "n") -> None:
    """Counts are finite and not negative."""
    if column not in counts.columns:
        raise ValueError(f"column '{column}' not found in counts")
    n = F.col(column).cast("double")
    bad = counts.agg(F.min(n).alias("lo"), F.max(F.isnan(n) | (F.abs(n) == float("inf")) | n.isNull()).alias("odd")).first()
    if bad.odd or (bad.lo is not None and bad.lo < 0):
        raise ValueError("counts must be finite and non-negative")


def check_condition(cells: DataFrame, condition: str) -> list[str]:
    """The two levels, sorted; the second is the tested one."""
    if condition not in cells.columns:
        raise ValueError(f"condition '{condition}' not found in cells")
    r = cells.agg(F.array_sort(F.collect_set(F.col(condition).cast("string"))), F.max(F.col(condition).isNull())).first()
    if len(r[0] or []) != 2:
        raise ValueError(f"condition '{condition}' must have exactly two levels")
    if r[1]:
        raise ValueError(f"condition '{condition}' has missing values")
    return list(r[0])


def check_covariates(cells: DataFrame, covariates) -> None:
    missing = [c for c in covariates if c not in cells.columns]
    if missing:
        raise ValueError(f"covariates not found in cells: {', '.join(missing)}")
    if covariates:
        r = cells.agg(*[F.max(F.col(c).isNull()).alias(c) for c in covariates]).first()
        if any(r):
            raise ValueError("covariates have missing values")


def sample_levels(cells: DataFrame, columns) -> DataFrame:
    """Distinct values of each column within every sample."""
    return cells.groupBy("sample_id").agg(*[F.count_distinct(c).alias(c) for c in columns])


def check_samples(cells: DataFrame, condition: str | None, covariates=()) -> None:
    """For random effects: the condition is constant within samples and no covariate is constant within all."""
    cols = ([condition] if condition else []) + list(covariates)
    n = cells.select("sample_id").distinct().count()
    if cols:
        most = sample_levels(cells, cols).agg(*[F.max(c).alias(c) for c in cols]).first()
        if condition and most[condition] > 1:
            raise ValueError(f"condition '{condition}' varies within sample")
        fixed = [c for c in covariates if most[c] <= 1]
        if fixed:
            raise ValueError(f"covariates constant within sample are confounded with the random intercept: {', '.join(fixed)}")
    if n < 3:
        warnings.warn("fewer than three samples: variance components are poorly determined", stacklevel=2)


def check_fdr(fdr: float) -> None:
    if isinstance(fdr, bool) or not isinstance(fdr, int | float) or not 0 < fdr <= 1:
        raise ValueError("fdr must be a number in (0, 1]")


def check_prop(prop: float) -> None:
    if isinstance(prop, bool) or not isinstance(prop, int | float) or not 0 < prop <= 1:
        raise ValueError("re_prop must be a number in (0, 1]")


def check_niches(niches: DataFrame, sigmas) -> None:
    have = {r[0] for r in niches.select("sigma").distinct().collect()}
    missing = sorted({float(s) for s in sigmas} - have)
    if missing:
        raise ValueError(f"niches not found for bandwidths: {missing}")
