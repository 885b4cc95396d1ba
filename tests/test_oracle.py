"""Every registered query against its SQL on DuckDB."""

import pytest

import __spark_entry__ as entry
from compare import difference, sql_connection

SF_DIR = "/root/testdata/sf0.001"
QUERIES, SQL = entry.queries(), entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return sql_connection(SF_DIR)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF_DIR)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan
    assert difference(df, con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_every_sql_belongs_to_a_query():
    assert not set(SQL) - set(QUERIES)


def test_entry_is_the_daily_mart(spark):
    df = entry.entry(spark)
    assert df.columns == [
        "transaction_date", "category", "currency", "total_amount", "transaction_count",
        "avg_amount",
    ]
    assert df.count() > 0
