import importlib
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from nichespark.sources import simulate, tissue

ROOT = Path(__file__).resolve().parents[1]
DATA = Path("/root/testdata/sf0.001")


def test_simulated_tissues(spark, tmp_path):
    t, truth = simulate.sim_reference(spark, samples=4, per=40, genes=30, planted=3)
    assert t.cells.count() == 160 and truth.where("planted").count() == 9 and truth.groupBy("category").count().count() == 3
    for kind in simulate.LAYOUTS:
        own = simulate.layout(spark, kind, 200, 3)
        assert own.cells.select("cell_type").distinct().count() == (4 if kind == "multiniche" else 3)
    with pytest.raises(ValueError):
        simulate.layout(spark, "none")
    tissue.write_bundle(t, f"{tmp_path}/b")
    back = tissue.read_bundle(spark, f"{tmp_path}/b")
    assert back.counts.agg(F.sum("n")).first() == t.counts.agg(F.sum("n")).first()


@pytest.mark.skipif(not DATA.exists(), reason="the driver's tables are absent")
def test_order_tissue_and_entry(spark):
    t = tissue.order_tissue(spark, str(DATA))
    assert t.cells.count() == 150 and t.cells.groupBy("sample_id").agg(F.count_distinct("condition").alias("k")).where("k <> 1").count() == 0
    entry = importlib.import_module("__spark_entry__")
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert "hierarchical_fdr" in entry.queries()


def test_the_rest_stands_without_the_corpus_package(tmp_path):
    shutil.copytree(ROOT / "nichespark", tmp_path / "nichespark", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(ROOT / "__spark_entry__.py", tmp_path)
    code = "import __spark_entry__ as e; print(len(e.queries()), any(k.startswith('op') for k in e.queries()), len(e.oracle_sql()))"
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, env={"PATH": "/usr/bin:/bin", "HOME": "/root"})
    assert out.returncode == 0, out.stderr
    n, corpus, sql = out.stdout.split()
    assert int(n) > 30 and corpus == "False" and int(sql) > 30
