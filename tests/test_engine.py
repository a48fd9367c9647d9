import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nichespark.functions import expr, special
from nichespark.operators import fdr as layers
from nichespark.operators import fit as fitting
from nichespark.operators import gsea, inference, nb
from nichespark.operators.combine import combine_bandwidths, relative_weights
from nichespark.operators.design import build_design
from nichespark.operators.niches import build_niches, detect_sigmas, merge_niches
from nichespark.operators.sizefactors import compute_size_factors, ls_matrix
from nichespark.plans import pipeline, validate
from nichespark.sources import simulate


@pytest.fixture(scope="module")
def toy(spark):
    t = simulate.toy(spark)
    t.cells, t.counts = t.cells.persist(), t.counts.persist()
    return t


@pytest.fixture(scope="module")
def niches(toy):
    return build_niches(toy.cells, [15, 20]).persist()


def brute_density(cells, sigma, edge, diggle):
    out = {}
    phi = lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2)))
    for s, own in cells.groupby("sample_id"):
        x0, x1, y0, y1 = own.x.min(), own.x.max(), own.y.min(), own.y.max()
        mass = {r.cell_id: (phi((x1 - r.x) / sigma) - phi((x0 - r.x) / sigma)) * (phi((y1 - r.y) / sigma) - phi((y0 - r.y) / sigma)) for r in own.itertuples()}
        for c in own.itertuples():
            for t in "ABC":
                v = 0.0
                for j in own[own.cell_type == t].itertuples():
                    k = 0.5 * math.exp(-((c.x - j.x) ** 2 + (c.y - j.y) ** 2) / (2 * sigma**2))
                    v += k / (mass[j.cell_id if diggle else c.cell_id] if edge else 1)
                out[c.cell_id, t] = v
    return out


@pytest.mark.parametrize(("edge", "diggle", "cutoff"), [(True, True, None), (True, False, None), (False, False, None), (True, True, 8.0)])
def test_density(spark, toy, edge, diggle, cutoff):
    few = toy.cells.where("sample_id in ('S1', 'S2')")
    got = {(r.cell_id, r.ct_niche): r.density for r in build_niches(few, [25], edge, diggle, cutoff, chunk=13).collect()}
    want = brute_density(few.toPandas(), 25.0, edge, diggle)
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 * (1 + want[k]) for k in got)


def test_niche_properties(toy, niches):
    assert [r[0] for r in detect_sigmas(niches).collect()] == [15.0, 20.0]
    r = niches.agg(F.min("density"), F.count(F.when(F.col("density").isNull(), 1)), F.count("*")).first()
    assert r[0] >= 0 and r[1] == 0 and r[2] == 480 * 3 * 2
    b = niches.where("sigma = 15 and ct_niche = 'B'").join(toy.cells, "cell_id")
    assert b.agg(F.corr("density", "x")).first()[0] > 0.4


def test_merge(niches):
    m, g = merge_niches(niches, {"AC": ["A", "C", "unknown"], "none": ["zz"]}, [20])
    w = m.where("sigma = 20").groupBy("cell_id").pivot("ct_niche").sum("density").join(niches.where("sigma = 20").groupBy("cell_id").pivot("ct_niche", ["A", "C"]).sum("density"), "cell_id")
    assert w.where("abs(AC - A - C) > 1e-12 or none <> 0").count() == 0
    assert {(r.niche, r.member) for r in g.where("sigma = 20").collect()} == {("AC", "A"), ("AC", "C"), ("B", "B")}
    _, g2 = merge_niches(m, {"ACB": ["AC", "B"]}, [20], g)
    assert {r.member for r in g2.where("sigma = 20 and niche = 'ACB'").collect()} == {"A", "B", "C"}
    with pytest.raises(ValueError, match="not found"):
        merge_niches(niches, {"AC": ["A"]}, [99])


def test_size_factors(spark, toy):
    ls = compute_size_factors(toy.cells)
    assert ls.groupBy("sample_id").agg(F.count_distinct("LS").alias("k")).where("k <> 1").count() == 0
    assert ls.select("LS").distinct().count() == 6
    assert ls_matrix(toy.cells).groupBy("cell_type").agg(F.avg("ls").alias("m")).where("abs(m) > 1e-8").count() == 0
    with pytest.raises(ValueError, match="not found"):
        compute_size_factors(toy.cells.drop("area"))


def tags(d):
    return [t.type for t in d.terms]


def test_designs(spark, toy, niches):
    d = build_design(toy.cells, niches, 20, "condition")
    assert tags(d).count("ResponseNiche") == 6 and tags(d).count("Niche") == 4 and len(d.terms) == 19
    ids, w = d.matrix()
    assert np.linalg.matrix_rank(w) == 19 and len(ids) == 480
    assert build_design(toy.cells, niches, 20, "condition", full_niche_block=True).matrix()[1].shape[1] == 21
    assert all(t.ct_index != t.ct_niche for t in d.terms if t.ct_niche and t.ct_index)
    only = build_design(toy.cells, niches, 20, "condition", niche=["B"])
    assert tags(only).count("ResponseNiche") == 2
    a = build_design(toy.cells, niches, 20, "condition", index=["A"])
    assert {t.ct_index for t in a.terms if t.type == "ResponseNiche"} == {"A"} and tags(a).count("ResponseCellType") == 3
    free = build_design(toy.cells, niches, 20)
    assert tags(free) == ["CellType"] * 3 + ["Niche"] * 6 and free.mode == "niche" and np.linalg.matrix_rank(free.matrix()[1]) == 9
    merged, groups = merge_niches(niches, {"AC": ["A", "C"]}, [20])
    assert tags(build_design(toy.cells, merged, 20, niche_groups=groups)).count("Niche") == 3
    slope = build_design(toy.cells, niches, 20, "condition", random="slope")
    assert [t.re_group for t in slope.terms].count("SampleInt") == 6 and [t.re_group for t in slope.terms].count("SampleSlope") == 24
    with pytest.raises(ValueError, match="two levels"):
        build_design(toy.cells.withColumn("three", F.concat(F.lit("l"), F.col("cell_id") % 3)), niches, 20, "three")
    with pytest.raises(ValueError, match="no requested"):
        build_design(toy.cells, niches, 20, niche=["zz"])


def test_checks(spark, toy):
    with pytest.raises(ValueError, match="varies"):
        validate.check_samples(toy.cells.withColumn("c", F.col("cell_id") % 2), "c")
    with pytest.raises(ValueError, match="constant within sample"):
        validate.check_samples(toy.cells, "condition", ["age"])
    with pytest.warns(UserWarning, match="three samples"):
        validate.check_samples(toy.cells.where("sample_id in ('S1', 'S2')"), "condition")
    for bad in (0, 1.5, "x", True):
        with pytest.raises(ValueError):
            validate.check_fdr(bad)
    with pytest.raises(ValueError, match="non-negative"):
        validate.check_counts(spark.createDataFrame([("G", 1, -1)], "gene string, cell_id long, n long"))
    with pytest.raises(ValueError, match="not found"):
        validate.check_cells(toy.cells.drop("cell_type"))


def test_stratified(spark):
    rows = [(i, f"S{i % 3}", "A") for i in range(1500)] + [(2000 + i, f"S{i % 3}", "B") for i in range(40)]
    cells = spark.createDataFrame(rows, "cell_id long, sample_id string, cell_type string")
    got = fitting.stratified_cells(cells, 0.1).join(cells, "cell_id").groupBy("sample_id", "cell_type").count().collect()
    n = {(r[0], r[1]): r["count"] for r in cells.groupBy("sample_id", "cell_type").count().collect()}
    assert all(r["count"] == min(n[r[0], r[1]], max(math.ceil(0.1 * n[r[0], r[1]]), 100)) for r in got) and len(got) == 6
    assert fitting.stratified_cells(cells, 1).count() == 1540


def test_special_functions(spark):
    x = np.array([0.1, 0.5, 1, 3.7, 20, 500.5])
    assert np.allclose(special.lgamma(x), [math.lgamma(v) for v in x], rtol=1e-12)
    t = np.array([-40.0, -3.1, -0.2, 0.0, 1.4, 9.0])
    rows = spark.createDataFrame([(float(v), d) for v in t for d in (1.0, 4.5, 30.0, None)], "t double, df double")
    for r in rows.select("t", "df", expr.pt(F.col("t"), F.col("df")).alias("lo"), expr.pt(F.col("t"), F.col("df"), False).alias("hi")).collect():
        assert math.isclose(r.lo, float(special.pt(r.t, r.df)), rel_tol=1e-9, abs_tol=1e-300)
        assert math.isclose(r.hi, float(special.pt(r.t, r.df, False)), rel_tol=1e-9, abs_tol=1e-300)
    assert math.isclose(float(special.pt(2.0, 1.0, False)), 0.5 - math.atan(2.0) / math.pi, rel_tol=1e-12)
    for v, d in ((3.0, 2.0), (0.1, 7.0), (60.0, 11.0)):
        spark_v = spark.range(1).select(expr.pchisq_upper(F.lit(v), F.lit(d))).first()[0]
        assert math.isclose(spark_v, float(special.pchisq_upper(v, d)), rel_tol=1e-9)
    assert math.isclose(float(special.pchisq_upper(3.0, 2.0)), math.exp(-1.5), rel_tol=1e-12)


def bh(p):
    o = np.argsort(p)
    q = np.empty(len(p))
    q[o] = np.minimum(1, np.minimum.accumulate((np.array(p)[o] * len(p) / np.arange(1, len(p) + 1))[::-1])[::-1])
    return q


def test_bh_and_cauchy(spark):
    rng = np.random.default_rng(1)
    rows = [(f"f{k}", i, float(v)) for k in range(4) for i, v in enumerate(np.round(rng.random(20) ** 2, 2))]
    df = spark.createDataFrame([*rows, ("f0", 99, None)], "f string, i int, p double")
    out = {(r.f, r.i): r.q for r in expr.bh_adjust(df, "p", ["f"], ["i"], "q").collect()}
    for k in range(4):
        p = [v for f, _, v in rows if f == f"f{k}"]
        assert np.allclose([out[f"f{k}", i] for i in range(20)], bh(p))
    assert out["f0", 99] is None
    c = spark.createDataFrame([("a", 0.03, 1.0), ("a", 0.03, 2.0), ("b", 0.2, 1.0), ("b", 0.9, 0.0), ("c", 0.2, 1.0), ("c", None, 5.0), ("d", 1e-14, 1.0)], "k string, p double, w double")
    got = {r.k: r.p for r in c.groupBy("k").agg(expr.cauchy(F.col("p"), F.col("w")).alias("p")).collect()}
    assert math.isclose(got["a"], 0.03, rel_tol=1e-9) and math.isclose(got["b"], 0.2, rel_tol=1e-9) and math.isclose(got["c"], 0.2, rel_tol=1e-9) and math.isclose(got["d"], 1e-14, rel_tol=1e-3)
    ll = spark.createDataFrame([("g", 1.0, -10.0), ("g", 2.0, -10.5), ("g", 3.0, -20.0)], "gene string, sigma double, loglik double")
    assert [r.weight for r in relative_weights(ll).orderBy("sigma").collect()] == [1.0, math.exp(-0.5), 0.0]
    p = spark.createDataFrame([("g", s, 0.01) for s in (1.0, 2.0, 3.0)], "gene string, sigma double, p double")
    assert math.isclose(combine_bandwidths(p, relative_weights(ll), ["gene"], ["p"]).first().p, 0.01, rel_tol=1e-9)


def test_irls_and_wald_closed_form():
    rng = np.random.default_rng(3)
    n = 300
    w = np.column_stack([np.ones(n), rng.normal(size=n), rng.normal(size=n)])
    y = rng.poisson(rng.gamma(2.0, np.exp(w @ [1.0, 0.5, -0.3]) / 2.0)).astype(float)
    a = nb.irls(y, w, 0.5, np.zeros(3))
    mu = np.exp(w @ a)
    assert np.abs(w.T @ ((y - mu) / (1 + 0.5 * mu))).max() < 1e-5
    assert 0.3 < nb.peak(nb.profile(y, w, mu, np.zeros(3))) < 0.8
    sel = np.array([1, 2])
    r = inference.wald_gene(a, 0.5, y, w, sel, np.array([True, True]), ["A", "B"], ["A", "B"], None, None, 3, None, "cauchy")
    d = mu / (1 + 0.5 * mu)
    v = np.linalg.inv(w[:, sel].T @ (w[:, sel] * d[:, None]))
    assert np.allclose(r["se"], np.sqrt(0.5 * np.diag(v)), rtol=1e-8) and np.allclose(r["t"], a[sel] / r["se"], rtol=1e-10)
    pen = np.array([0.0, 0, 4.0])
    m = inference.wald_gene(a, 0.5, y, w, sel, np.array([True, True]), ["A", "B"], ["A", "B"], pen, 12.0, 2, np.array([0.4, 0.6]), "cauchy")
    full = np.linalg.inv(w.T @ (w * d[:, None]) + np.diag(pen))[np.ix_(sel, sel)]
    phi = ((y - mu) ** 2 / (mu + 0.5 * mu**2)).sum() / (n - 2)
    assert np.allclose(m["se"], np.sqrt(phi * np.diag(full)), rtol=1e-8)
    assert math.isclose(m["se_patient"], math.sqrt(phi * np.array([0.4, 0.6]) @ full @ [0.4, 0.6]), rel_tol=1e-8)
    b = inference.wald_gene(np.array([1.0, 3, 3]), 0.5, y, w, sel, np.array([True, True]), ["A", "B"], ["A", "B"], None, None, 3, None, "brown")
    assert b["up"][0] < 0.05 and b["down"][0] > 0.5
    p = np.array([0.02, 0.4, 0.7])
    fisher = special.pchisq_upper(-2 * np.log(p).sum(), 6.0)
    assert math.isclose(inference.brown(p, np.eye(3)), float(fisher), rel_tol=1e-10)


def test_satterthwaite_against_brute_force():
    rng = np.random.default_rng(5)
    n, s = 60, 5
    sample = np.repeat(np.arange(s), n // s)
    x = np.column_stack([np.ones(n), rng.normal(size=n)])
    z = (sample[:, None] == np.arange(s)).astype(float)
    w, wt, tau2 = np.column_stack([x, z]), rng.uniform(0.5, 2, n), 0.6
    pen = np.array([0.0, 0.0] + [1 / tau2] * s)
    a = w.T @ (w * wt[:, None])
    minv = np.linalg.inv(a + np.diag(pen))
    info = fitting.variance_information(a, minv, pen, [np.arange(2, 7)], n)
    v = np.diag(1 / wt) + tau2 * z @ z.T
    vi = np.linalg.inv(v)
    p = vi - vi @ x @ np.linalg.inv(x.T @ vi @ x) @ x.T @ vi
    d = [np.diag(1 / wt), z @ z.T]
    brute = np.array([[0.5 * np.trace(p @ d[i] @ p @ d[j]) for j in range(2)] for i in range(2)])
    assert np.allclose(info, brute, rtol=1e-6)
    df = fitting.satterthwaite(a, minv, pen, [np.arange(2, 7)], [tau2], np.array([0, 1]), n)
    assert 1 <= df[0] <= 10 and df[1] > 30


def test_mean_correlation():
    rng = np.random.default_rng(2)
    for p in (5, 40):
        x = rng.normal(size=(200, p)) + 0.5 * rng.normal(size=(200, 1))
        z = (x - x.mean(0)) / x.std(0, ddof=1)
        c = np.corrcoef(x.T)
        assert abs(inference.mean_correlation(z.sum(1), p) - c[np.triu_indices(p, 1)].mean()) < 1e-8
    assert inference.mean_correlation(np.ones(5), 1) == 0


def test_gene_index_gate(spark):
    base = {f"G{i}": (0.9, 0.9, 0.9) for i in range(2, 6)}
    frame = lambda pos, neg: spark.createDataFrame([(g, *lv, pos[g][k], neg[g][k]) for g in pos for k, lv in enumerate([("Gene", None), ("Index", "A"), ("Index", "B")])], "gene string, level string, ct_index string, p_pos double, p_neg double")
    up = {"G1": (1e-6, 1e-6, 0.9), **base}
    none = {"G1": (0.9, 0.9, 0.9), **base}
    rows = layers.gene_index_fdr(frame(up, none), 0.05, False).collect()
    assert [(r.gene, r.ct_index, r.direction) for r in rows] == [("G1", "A", "Up")] and math.isclose(rows[0].fdr_gene, 1e-5)
    assert layers.gene_index_fdr(frame(up, up), 0.05, False).first().direction == "Both"
    assert math.isclose(layers.gene_index_fdr(frame(up, up), 0.05, True).first().fdr_gene, 5e-6)
    assert layers.gene_index_fdr(frame(none, none), 0.05, False).count() == 0
    assert layers.gene_index_fdr(frame(none, none), 1, True).count() == 10


def test_pipeline_with_condition(spark, toy):
    cells = compute_size_factors(toy.cells)
    res = pipeline.run(cells, toy.counts, "condition", [30.0], covariates=["age", "LS"], niches=build_niches(cells, [30.0]))
    rows = res.results().collect()
    hit = [r for r in rows if (r.gene, r.ct_index, r.ct_niche) == ("G1", "A", "B")]
    assert len(hit) == 1 and hit[0].DirectionNiche == "Up" and abs(hit[0].t) > 4
    assert max((r for r in rows if r.gene == "G1" and r.ct_index == "A"), key=lambda r: abs(r.t)).ct_niche == "B"
    g = res.fits[0].genes.agg(F.min("psi"), F.max("loglik")).first()
    assert g[0] > 0 and g[1] <= 0
    assert res.results("celltype").columns == ["gene", "ct_index", "p", "fdr_gene", "fdr_celltype"]
    assert res.results("patient").columns == ["gene", "coef", "p", "fdr", "Direction"]
    sets = spark.createDataFrame([("planted", f"G{i}") for i in range(1, 7)] + [("other", f"G{i}") for i in range(7, 15)], "geneset string, gene string")
    tab, rho = pipeline.gene_sets(res, sets, test="self-contained", fdr=1.0, rho=0.25)
    assert rho == {30.0: 0.25} and set(tab.columns) >= {"geneset", "collection", "size", "z", "fdr_niche"}
    tab, rho = pipeline.gene_sets(res, sets.where("geneset = 'planted'"), fdr=1.0)
    assert tab.count() > 0 and abs(rho[30.0]) < 0.2
    assert "bandwidths 30" in repr(res) and "30" in repr(res.fits[0])
    up = pipeline.test(res, combine="brown")
    assert not up.fits[0].two_sided
    own = up.pcomb.where("gene = 'G1' and ct_index = 'A'").first()
    assert own.p_pos < 0.01 < own.p_neg and up.results().columns == res.results().columns
    with pytest.raises(ValueError):
        pipeline.fit(cells, toy.counts, None, sigma=[30.0], backend="gpu")


def test_pipeline_without_condition(spark):
    t = simulate.toy(spark, with_condition=False)
    res = pipeline.run(t.cells, t.counts, None, [30.0])
    hit = [r for r in res.results().collect() if (r.gene, r.ct_index, r.ct_niche) == ("G1", "A", "B")]
    assert len(hit) == 1 and hit[0].DirectionNiche == "Up"
    assert res.results("celltype").count() == 0 and res.results("patient").count() == 0 and "niche-only" in repr(res)


def test_mixed_effects(spark):
    t = simulate.toy_clustered(spark, samples=8, per=80, genes=15, seed=3)
    niches = build_niches(t.cells, [30]).persist()
    fixed = pipeline.fit(t.cells, t.counts, niches, "condition")
    mixed = pipeline.fit(t.cells, t.counts, niches, "condition", random="intercept", re_maxit=6)
    f = mixed.fits[0]
    assert 0.2 < f.tau2["SampleInt"] < 1.0 and len(f.penalty) == len(f.design.terms) and len(f.df) == len(f.sel)
    rate = []
    for r in (fixed, mixed):
        pipeline.test(r, 0.05)
        rc = r.wald().where("type = 'ResponseCellType'").withColumn("p", expr.two_sided(F.col("t"), F.col("df")))
        rate.append(rc.agg(F.avg((F.col("p") < 0.05).cast("double"))).first()[0])
    assert rate[0] > 0.30 and rate[1] < 0.20
    tested = [f.design.terms[i].type for i in f.sel]
    df = dict(zip(tested, f.df, strict=True))
    assert df["ResponseCellType"] < 12 and np.median([d for d, k in zip(f.df, tested, strict=True) if k == "ResponseNiche"]) > 50
    assert fitting.between_df("condition", [x.re_group for x in f.design.terms], 640) == 6
    assert fitting.between_df("niche", [None] * 9 + ["SampleInt"] * 6, 480) == 471
    assert fitting.between_df("niche", [None] * 9 + ["SampleInt"] * 6 + ["SampleSlope"] * 36, 480) == 5


def test_gene_set_statistics(spark):
    rng = np.random.default_rng(4)
    z = [(1.0, f"g{i}", "A", "B", float(rng.normal() + (2 if i < 10 else 0))) for i in range(100)]
    zt = spark.createDataFrame(z, "sigma double, gene string, ct_index string, ct_niche string, z double")
    sets = gsea.usable_sets(spark.createDataFrame([("s", f"g{i}") for i in range(10)] + [("s", "zz"), ("s", "g1"), ("tiny", "g1")], "geneset string, gene string"), zt)
    assert sets.count() == 10
    rho = spark.createDataFrame([(1.0, 0.1)], "sigma double, rho double")
    v = np.array([r[4] for r in z])
    vif = 1 + 0.1 * 9
    got = gsea.set_statistics(zt, sets, rho).first().stat
    want = (v[:10].mean() - v[10:].mean()) / v.std(ddof=1) / math.sqrt(vif / 10 + 1 / 90)
    assert math.isclose(got, want, rel_tol=1e-9)
    shifted = gsea.set_statistics(zt.withColumn("z", F.col("z") + 5), sets, rho).first()
    assert math.isclose(shifted.stat, want, rel_tol=1e-9) and math.isclose(shifted.zbar, v[:10].mean() + 5, rel_tol=1e-9)
    self_ = gsea.set_statistics(zt, sets, rho, "self-contained").first().stat
    assert math.isclose(self_, v[:10].mean() / math.sqrt(vif / 10), rel_tol=1e-9)
    t = spark.createDataFrame([(float(x), 8.0) for x in (-40, -3, -0.5, 0, 0.5, 3, 40)], "t double, df double")
    out = [(r.t, r.z) for r in t.select("t", gsea.t_to_z(F.col("t"), F.col("df")).alias("z")).collect()]
    assert all(np.sign(a) == np.sign(b) and abs(b) <= abs(a) and math.isfinite(b) for a, b in out)
    tab = spark.createDataFrame([("all", s, i, n, p, 1.0) for s, ps in (("s1", 1e-6), ("s2", 0.8)) for i in "AB" for n in "XY" for p in [ps]], "collection string, geneset string, ct_index string, ct_niche string, p double, z double")
    assert {r.geneset for r in gsea.cascade(tab, 0.05).collect()} == {"s1"} and gsea.cascade(tab, 0.05).count() == 4
    assert "fdr_niche" not in gsea.cascade(tab, 0.05, nested=False).columns


def test_migration_and_storage(spark, tmp_path):
    old = spark.createDataFrame([(30.0,)], "sigma double")
    new = pipeline.migrate(old, "fit_bandwidth")
    assert new.first().mode == "condition" and new.first().rho is None


def test_streamed_size_factors(spark, toy, tmp_path):
    from nichespark.operators.sizefactors import size_factors
    from nichespark.streaming import partials

    toy.cells.repartition(5).write.parquet(f"{tmp_path}/in")
    q = partials.start(spark.readStream.schema(toy.cells.schema).parquet(f"{tmp_path}/in"), "sums", f"{tmp_path}/check")
    q.processAllAvailable()
    q.stop()
    got = {r.sample_id: r.ls for r in partials.current(spark, "sums").collect()}
    want = {r.sample_id: r.ls for r in size_factors(toy.cells).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in got)
