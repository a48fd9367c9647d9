"""The interaction design: which columns exist, what they mean, and their values per cell.

Columns are generated with their tags, never parsed from names. Condition mode has, in order,
covariates, cell types, niche main effects, type:condition, type:niche (without the first type, which
the main effects alias) and type:condition:niche; without a condition there are covariates, cell types
and type:niche for every type. A type against a niche that it belongs to is dropped. Random columns
(one per sample, and with slopes one per sample and Niche column) come last.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans import validate

#: Bytes of a dense design that may be gathered and sent to the executors.
MAX_DESIGN = 1 << 30
#: Levels of a categorical covariate, which has an indicator column for each but the first.
MAX_LEVELS = 1000


def sanitise(name: str) -> str:
    return re.sub(r"[ -]", ".", name)


@dataclass(frozen=True)
class Term:
    """One column: an indicator of a type (and tested condition level) times a niche or covariate."""

    covariate: str
    type: str
    ct_index: str | None = None
    ct_niche: str | None = None
    re_group: str | None = None
    cell_type: str | None = None
    conditioned: bool = False
    niche: str | None = None
    numeric: str | None = None
    sample: str | None = None
    factor: str | None = None
    level: str | None = None


@dataclass
class Design:
    sigma: float
    mode: str
    terms: list[Term]
    condition: str | None = None
    levels: list[str] = field(default_factory=list)
    cells: DataFrame | None = None
    niches: DataFrame | None = None

    def coefmap(self, spark) -> DataFrame:
        """coefmap(sigma, pos, covariate, type, ct_index, ct_niche, re_group)."""
        rows = [(self.sigma, i, t.covariate, t.type, t.ct_index, t.ct_niche, t.re_group) for i, t in enumerate(self.terms)]
        return spark.createDataFrame(rows, "sigma double, pos int, covariate string, type string, ct_index string, ct_niche string, re_group string")

    @property
    def tested(self) -> np.ndarray:
        return np.array([t.type == "Niche" if self.mode == "niche" else "Response" in t.type for t in self.terms])

    @property
    def niche_tested(self) -> np.ndarray:
        return np.array([t.type == ("Niche" if self.mode == "niche" else "ResponseNiche") for t in self.terms])

    def frame(self) -> DataFrame:
        """design(cell_id, w array<double>), w ordered as terms."""
        names = sorted({t.niche for t in self.terms if t.niche})
        wide = self.cells
        if names:
            # a map per cell instead of a pivot: no column count to fix, one aggregate
            m = self.niches.where(F.col("sigma") == self.sigma).groupBy("cell_id").agg(F.map_from_entries(F.collect_list(F.struct("ct_niche", "density"))).alias("__niche"))
            wide = wide.join(m, "cell_id")
        value: list[Column] = []
        for t in self.terms:
            v = F.lit(1.0)
            if t.cell_type is not None:
                v = v * (F.col("__ct") == t.cell_type).cast("double")
            if t.conditioned:
                v = v * (F.col(self.condition).cast("string") == self.levels[1]).cast("double")
            if t.sample is not None:
                v = v * (F.col("sample_id").cast("string") == t.sample).cast("double")
            if t.niche is not None:
                v = v * F.log1p(F.coalesce(F.element_at("__niche", F.lit(t.niche)), F.lit(0.0)))
            if t.factor is not None:
                v = v * (F.col(t.factor).cast("string") == t.level).cast("double")
            if t.numeric is not None:
                v = v * F.col(t.numeric).cast("double")
            value.append(v)
        return wide.select("cell_id", F.array(*value).alias("w"))

    def matrix(self) -> tuple[np.ndarray, np.ndarray]:
        """(sorted cell ids, W): gathered on the driver; its size is checked first."""
        n = self.cells.count()
        if n * len(self.terms) * 8 > MAX_DESIGN:
            raise ValueError(f"a design of {n} cells and {len(self.terms)} columns exceeds {MAX_DESIGN} bytes")
        t = self.frame().toArrow()
        ids = t.column("cell_id").to_numpy()
        flat = t.column("w").combine_chunks().flatten().to_numpy(zero_copy_only=False) if n else np.zeros(0)
        w = flat.reshape(len(ids), len(self.terms))
        if not np.isfinite(w).all():
            raise ValueError("the design has missing values")
        order = np.argsort(ids)
        return ids[order], w[order]


def build_design(cells: DataFrame, niches: DataFrame, sigma: float, condition: str | None = None, index=None, niche=None, covariates=(), random: str = "none", niche_groups: DataFrame | None = None, full_niche_block: bool = False) -> Design:
    """The design of one bandwidth. full_niche_block: keep the first type's niche columns in condition mode."""
    if random not in ("none", "intercept", "slope"):
        raise ValueError("random must be none, intercept or slope")
    validate.check_cells(cells)
    validate.check_covariates(cells, covariates)
    validate.check_niches(niches, [sigma])
    levels = validate.check_condition(cells, condition) if condition else []
    ct = F.regexp_replace(F.col("cell_type"), "[ -]", ".")
    at = niches.where(F.col("sigma") == float(sigma)).withColumn("ct_niche", F.regexp_replace("ct_niche", "[ -]", "."))
    types = [r[0] for r in cells.select(ct.alias("t")).distinct().orderBy("t").collect()]
    names = [r[0] for r in at.select("ct_niche").distinct().orderBy("ct_niche").collect()]
    members: dict[str, set[str]] = {n: {n} for n in names}
    if niche_groups is not None:
        found: dict[str, set[str]] = {}
        for r in niche_groups.where(F.col("sigma") == float(sigma)).collect():
            found.setdefault(sanitise(r.niche), set()).add(sanitise(r.member))
        members |= found
    if niche is not None:
        names = [n for n in dict.fromkeys(sanitise(x) for x in niche) if n in names]
        if not names:
            raise ValueError("no requested niche cell types found among the niches")
    kinds = {f.name: f.dataType.typeName() for f in cells.schema}
    terms: list[Term] = []
    for cv in covariates:
        if kinds[cv] in ("string", "boolean"):
            own = [r[0] for r in cells.select(F.col(cv).cast("string").alias("v")).distinct().orderBy("v").limit(MAX_LEVELS + 1).collect()]
            if len(own) > MAX_LEVELS:
                raise ValueError(f"covariate '{cv}' has more than {MAX_LEVELS} levels")
            terms += [Term(f"{cv}{v}", "Other", factor=cv, level=v) for v in own[1:]]
        else:
            terms.append(Term(cv, "Other", numeric=cv))
    terms += [Term(f"CellType{t}", "CellType", ct_index=t, cell_type=t) for t in types]
    if condition:
        terms += [Term(n, "Other", ct_niche=n, niche=n) for n in names]
        terms += [Term(f"CellType{t}:{condition}{levels[1]}", "ResponseCellType", ct_index=t, cell_type=t, conditioned=True) for t in types]
    wanted = {sanitise(x) for x in index} if index is not None else set(types)
    for n in names:
        terms += [Term(f"CellType{t}:{n}", "Niche", t, n, cell_type=t, niche=n) for t in (types if not condition or full_niche_block else types[1:]) if t not in members[n] and t in wanted]
    if condition:
        for n in names:
            terms += [Term(f"CellType{t}:{condition}{levels[1]}:{n}", "ResponseNiche", t, n, cell_type=t, conditioned=True, niche=n) for t in types if t not in members[n] and t in wanted]
    if random != "none":
        samples = [r[0] for r in cells.select(F.col("sample_id").cast("string")).distinct().orderBy("sample_id").collect()]
        base = [t for t in terms if t.type == "Niche"]
        terms += [Term(f"Sample{s}", "Random", re_group="SampleInt", sample=s) for s in samples]
        if random == "slope":
            terms += [Term(f"Sample{s}:{b.covariate}", "Random", re_group="SampleSlope", sample=s, cell_type=b.cell_type, niche=b.niche) for b in base for s in samples]
    return Design(float(sigma), "condition" if condition else "niche", terms, condition, levels, cells.withColumn("__ct", ct), at)
