import pytest
from oracle_check import same

from rankloom.plans import oracle, queries

SQL = oracle.oracle()
BY_NAME = {q.__name__: q for q in queries.ALL}


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_agrees_with_sql(spark, data, name):
    same(BY_NAME[name](spark, data), SQL[name], data)


@pytest.mark.parametrize("name", sorted(set(BY_NAME) - set(SQL)))
def test_query_without_sql_runs(spark, data, name):
    df = BY_NAME[name](spark, data)
    assert df.columns and df.collect() is not None


def test_entry_runs_without_the_training_subpackage(spark, data):
    import __spark_entry__ as e

    names = set(e.queries())
    assert set(BY_NAME) <= names and set(e.oracle_sql()) <= names
