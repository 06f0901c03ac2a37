"""Plans: no products of tables anywhere, filters and columns reach the scans, folds stay native."""

import pytest

from inkweave.plans import catalog

SF = "/root/testdata/sf0.001"
QUERIES = catalog.load()


def plan(spark, name):
    return QUERIES[name].run(spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_product_of_tables(spark, name):
    p = plan(spark, name)
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_filters_and_columns_reach_the_scan(spark):
    p = plan(spark, "pricing_summary")
    assert "LessThanOrEqual(l_shipdate" in p and "l_orderkey" not in p
    p = plan(spark, "join_inner")
    assert "EqualTo(r_name,ASIA)" in p and "o_totalprice" not in p and "l_tax" not in p


@pytest.mark.parametrize("name", ["chunk_fold", "chunk_build", "page_view", "dictionary_best", "lexical_edges", "coverage_score", "highlight_span_overlap", "line_build"])
def test_no_python_on_native_paths(spark, name):
    p = plan(spark, name)
    assert not [w for w in ("Python", "Pandas", "Arrow") if w in p]
