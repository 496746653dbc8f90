import pytest
from oracle_check import same

from rankloom.llm import queries

SQL = queries.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, data, name):
    same(queries.queries()[name](spark, data), SQL[name], data)


COLUMNS = {
    "p1_found": ["stem", "unit_idx"], "p2_found": ["run_id", "stem"], "p3_found": ["place", "stem", "pos", "kind"], "p4_found": ["stem_a", "stem_b"], "p5_found": ["place", "rec", "entered", "skill"],
    "p6_found": ["stem", "line_no", "kind"], "p7_ids": ["doc_id", "ids"], "p9_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_runs(spark, data, name):
    df = queries.queries()[name](spark, data)
    assert df.columns == COLUMNS.get(name, df.columns)
    rows = df.collect()
    assert len(rows) == len({repr(r) for r in rows}) or name == "p7_ids"
