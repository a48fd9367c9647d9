import pytest

from nichespark.plans import pipeline, queries
from nichespark.sources import simulate


def nodes(df) -> int:
    return df._jdf.queryExecution().analyzed().treeString().count("\n")


def test_plans_of_layers_begin_at_settled_tables(spark):
    t = simulate.toy(spark)
    res = pipeline.run(t.cells, t.counts, "condition", sigma=[15, 20])
    assert nodes(res.results("niche")) < 100


@pytest.mark.parametrize(("query", "most"), [("gsea_cascade", 100), ("hierarchical_fdr", 100)])
def test_plans_of_queries_begin_at_settled_tables(spark, query, most):
    assert nodes(queries.queries()[query](spark, "/root/testdata/sf0.001")) < most
