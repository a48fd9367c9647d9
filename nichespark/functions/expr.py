"""Column expressions: sanitised names, normal and t tails, Cauchy combination, Benjamini-Hochberg.

Everything here runs in the JVM. The special functions use commons-math (on Spark's class path)
through ``reflect``; that call is not compiled into the stage, so apply it to result-sized tables.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, WindowSpec
from pyspark.sql import Window as W
from pyspark.sql import functions as F

ERF, BETA, GAMMA = (f"org.apache.commons.math3.special.{c}" for c in ("Erf", "Beta", "Gamma"))
TINY = 2.2250738585072014e-308
EPS = 1e-15


def _call(cls: str, method: str, *args: Column) -> Column:
    return F.reflect(F.lit(cls), F.lit(method), *[a.cast("double") for a in args]).cast("double")


def sanitise(c: Column) -> Column:
    """Spaces and hyphens become dots, as in all result tables."""
    return F.regexp_replace(c, "[ -]", ".")


def erf(x: Column) -> Column:
    return F.when(x.isNotNull(), _call(ERF, "erf", x))


def lgamma(x: Column) -> Column:
    return F.when(x.isNotNull(), _call(GAMMA, "logGamma", x))


def pnorm(z: Column, lower: bool = True) -> Column:
    """Normal tail probability, precise in both tails."""
    return F.when(z.isNotNull(), 0.5 * _call(ERF, "erfc", (-z if lower else z) / F.lit(math.sqrt(2))))


def pt(t: Column, df: Column | None = None, lower: bool = True) -> Column:
    """Tail probability of Student's t; the normal where df is None or null."""
    if df is None:
        return pnorm(t, lower)
    half = 0.5 * _call(BETA, "regularizedBeta", df / (df + t * t), df / 2, F.lit(0.5))
    own = F.when((t < 0) if lower else (t > 0), half).otherwise(1 - half)
    return F.when(df.isNull(), pnorm(t, lower)).when(t.isNotNull(), own)


def two_sided(t: Column, df: Column | None = None) -> Column:
    return F.least(F.lit(1.0), 2 * F.least(pt(t, df, True), pt(t, df, False)))


def pchisq_upper(x: Column, df: Column) -> Column:
    return F.when(x <= 0, 1.0).when(x.isNotNull(), _call(GAMMA, "regularizedGammaQ", df / 2, x / 2))


def clamp(p: Column) -> Column:
    return F.greatest(F.least(p, F.lit(1 - EPS)), F.lit(EPS))


def _cauchy_of(total: Column, weight: Column) -> Column:
    x = total / weight
    # the upper tail of a Cauchy variable, without cancellation for large x
    return F.when(weight > 0, F.when(x > 1, F.atan(1 / x) / math.pi).otherwise(0.5 - F.atan(x) / math.pi))


def cauchy(p: Column, w: Column | None = None) -> Column:
    """Aggregate: Cauchy combination of p with weights w (equal if None); null p drop out with their weight."""
    w = F.lit(1.0) if w is None else w
    use = p.isNotNull() & w.isNotNull()
    return _cauchy_of(F.sum(F.when(use & (w > 0), w * F.cot(p * math.pi))), F.sum(F.when(use, w)))


def cauchy_over(p: Column, window: WindowSpec, w: Column | None = None) -> Column:
    """The same combination as a window function over the rows of `window`."""
    w = F.lit(1.0) if w is None else w
    use = p.isNotNull() & w.isNotNull()
    return _cauchy_of(F.sum(F.when(use & (w > 0), w * F.cot(p * math.pi))).over(window), F.sum(F.when(use, w)).over(window))


def bh_adjust(df, p: str, family: list[str], ties: list[str], out: str, times: float = 1.0):
    """df plus `out`: the Benjamini-Hochberg adjusted p within family, times a factor and capped at 1.

    ties: columns that make the order total. Families are gene- or set-level result tables, whose rows
    number genes times tested columns, never cells.
    """
    key = family or [F.lit(1)]
    rank = F.row_number().over(W.partitionBy(*key).orderBy(F.col(p).asc_nulls_last(), *ties))
    n = F.count(p).over(W.partitionBy(*key))
    df = df.withColumns({"__r": rank, "__n": n})
    down = W.partitionBy(*key).orderBy(F.col("__r").desc()).rowsBetween(W.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.least(F.lit(1.0), F.min(F.col(p) * F.col("__n") / F.col("__r")).over(down)) * times)
    return df.withColumn(out, F.when(F.col(p).isNotNull(), q)).drop("__r", "__n")
