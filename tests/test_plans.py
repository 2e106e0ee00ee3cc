import pytest

from docloom.plans import catalog

DATA = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in catalog.queries() if not n.startswith("stream_")))
def test_no_cross_joins(spark, name):
    text = plan(catalog.queries()[name](spark, DATA))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_are_pruned(spark):
    text = plan(catalog.queries()["recommendation_histogram"](spark, DATA))
    assert "priors" not in text.split("ReadSchema:")[1].split("\n")[0]
    text = plan(catalog.queries()["main_counts"](spark, DATA))
    assert "summary" not in text and "PushedFilters: [IsNotNull(doc_id)]" in text


def test_sql_has_a_query_for_each_name():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
