"""The estimator's queries against their SQL on the smallest table whose groups are all filled, and pieces added around them."""

import math
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichespark.operators import fdr as layers
from nichespark.operators import fit as fitting
from nichespark.operators.design import build_design
from nichespark.operators.inference import block_size_of, covariance, covariances
from nichespark.operators.niches import build_niches
from nichespark.plans import closed
from nichespark.sources import simulate
from nichespark.streaming import partials

DATA = Path("/root/testdata/sf0.01")


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are absent")
@pytest.mark.parametrize("name", ["nb_fit", "pcomb_mixed", "brown_combine", "patient_one_bandwidth"])
def test_sql_twins(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in ("customer", "lineitem", "orders", "part"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = closed.queries()[name](spark, str(DATA))
    want = con.execute(f"SELECT {', '.join(df.columns)} FROM ({closed.oracle_sql()[name]})").fetchall()
    assert want and sorted(map(tuple, df.collect()), key=str) == sorted(want, key=str)


def test_factor_covariates(spark):
    cells = simulate.toy(spark).cells.withColumn("batch", F.concat(F.lit("b"), F.col("cell_id") % 3)).withColumn("odd", F.col("cell_id") % 2 == 1)
    d = build_design(cells, build_niches(cells, [20]), 20, "condition", covariates=["batch", "odd", "age"])
    assert [t.covariate for t in d.terms[:4]] == ["batchb1", "batchb2", "oddtrue", "age"] and {t.type for t in d.terms[:4]} == {"Other"}
    ids, w = d.matrix()
    assert np.array_equal(w[:, 0], ids % 3 == 1) and np.array_equal(w[:, 1], ids % 3 == 2) and np.array_equal(w[:, 2], ids % 2 == 1)
    assert np.linalg.matrix_rank(w) == w.shape[1]


def test_winsorised_coefficients(spark):
    rng = np.random.default_rng(1)
    a = rng.standard_t(2, (41, 3))
    a[:, 2] = 1.0
    genes = spark.createDataFrame([(f"g{i}", r.tolist(), 0.1, -1.0) for i, r in enumerate(a)], "gene string, alpha array<double>, psi double, loglik double")
    got = {r.gene: r.alpha for r in fitting.winsorise(genes, 2.0).collect()}
    mid = np.median(a, axis=0)
    dev = 1.4826 * np.median(np.abs(a - mid), axis=0)
    want = np.where(dev > 0, np.clip(a, mid - 2 * dev, mid + 2 * dev), a)
    assert np.allclose([got[f"g{i}"] for i in range(41)], want) and not np.allclose(want, a)


def test_blocks_of_genes():
    rng = np.random.default_rng(2)
    w, d, sel = rng.standard_normal((60, 7)), rng.uniform(0.1, 2, (5, 60)), np.array([1, 4, 6])
    for pen in (None, np.full(7, 0.3)):
        assert np.allclose(covariances(w, d, sel, pen), [covariance(w, x, sel, pen) for x in d], atol=1e-12)
    assert block_size_of(10**9, 20) == 1 and block_size_of(1000, 20) > 1000


def test_layers_of_one_bandwidth(spark):
    t = {("g1", "A"): 6.0, ("g1", "B"): -6.0, ("g2", "A"): 0.2, ("g2", "B"): -0.1, ("g3", "A"): 5.0, ("g3", "B"): 0.5}
    wald = spark.createDataFrame([(g, c, "ResponseCellType", x, None) for (g, c), x in t.items()], "gene string, ct_index string, type string, t double, df double")
    out = {(r.gene, r.ct_index): r for r in layers.celltype_fdr_of_t(wald, 0.05).collect()}
    assert {k: r.Direction for k, r in out.items()} == {("g1", "A"): "Up", ("g1", "B"): "Down", ("g3", "A"): "Up"}
    tail = 0.5 * math.erfc(6 / math.sqrt(2))
    assert math.isclose(out["g1", "A"].fdr_celltype, 2 * 2 * tail, rel_tol=1e-9) and math.isclose(out["g1", "A"].p, 2 * tail, rel_tol=1e-9)
    patient = spark.createDataFrame([("g1", 1.0, 0.2, None), ("g2", -1.0, 0.2, None), ("g3", 0.1, 0.2, None)], "gene string, beta double, se_patient double, df double")
    out = {r.gene: (r.Direction, r.t) for r in layers.patient_fdr_of_t(patient, 0.05).collect()}
    assert out == {"g1": ("Up", 5.0), "g2": ("Down", -5.0)}


def test_streamed_residuals(spark, tmp_path):
    rng = np.random.default_rng(3)
    z = rng.standard_normal((4, 30)) + rng.standard_normal(30)
    z = (z - z.mean(axis=1, keepdims=True)) / z.std(axis=1, ddof=1, keepdims=True)
    for g in range(4):
        spark.createDataFrame([(c, float(z[g, c])) for c in range(30)], "cell_id long, z double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    q = partials.start_rho(spark.readStream.schema("cell_id long, z double").parquet(f"{tmp_path}/in"), "rho_state", f"{tmp_path}/ck")
    q.processAllAvailable()
    got = partials.current_rho(spark, "rho_state")
    q.stop()
    r = np.corrcoef(z)
    assert math.isclose(got, (r.sum() - 4) / 12, rel_tol=1e-9)
