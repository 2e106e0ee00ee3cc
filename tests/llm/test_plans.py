import pytest

from docloom.llm.queries import queries

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries()))
def test_runs_without_cross_joins(spark, name):
    df = queries()[name](spark, DATA)
    text = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    rows = df.collect()
    assert all(len(r) == len(df.columns) for r in rows) and (rows or name in ("p10_found", "p4_found", "p4_pairs", "p1_found", "p1_pieces"))


def test_columns_of_found_queries(spark):
    columns = {
        "p1_found": [("extract_id", "bigint")],
        "p2_found": [("field", "string"), ("term", "string"), ("mark", "string")],
        "p3_found": [("field", "string"), ("row_key", "string"), ("kind", "string"), ("found_value", "string")],
        "p4_found": [("field", "string"), ("item_a", "string"), ("item_b", "string")],
        "p5_found": [("walk_id", "bigint"), ("field", "string"), ("pos", "int"), ("plan_id", "int")],
        "p6_found": [("extract_id", "bigint"), ("subject", "string")],
        "p7_found": [("extract_id", "bigint"), ("line_no", "int"), ("noise", "string")],
        "p10_found": [("doc_a", "bigint"), ("doc_b", "bigint")],
    }
    for name, expected in columns.items():
        assert queries()[name](spark, DATA).dtypes == expected
