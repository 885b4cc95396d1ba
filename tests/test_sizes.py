"""What a task holds and how often facts are dealt out."""

from ledgerloom.operators import joins as J
from ledgerloom.sources.tables import append_partitioned

from conftest import instant, rows_of

ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"


def test_facts_are_dealt_out_once_where_no_key_is_crowded(spark):
    dim = spark.createDataFrame(
        [("a", instant("2026-01-01"), None, 1)],
        "account_id string, valid_from timestamp, valid_to timestamp, account_sk long",
    )
    facts = spark.createDataFrame(
        [("t1", "a", instant("2026-01-02")), ("t2", "b", instant("2026-01-02"))],
        "transaction_id string, account_id string, transaction_timestamp timestamp",
    )
    found = J.pit_join(facts.hint("merge"), dim)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    assert rows_of(found, "transaction_id", "account_sk") == [("t1", 1), ("t2", -1)]


def test_tasks_hold_less_than_files(spark, tmp_path):
    assert spark.conf.get(ADVISORY) == "8m"
    rows = spark.createDataFrame([("x", 1), ("y", 2)], "k string, n int")
    seen = []

    def add(df):
        seen.append(df.columns)
        return df.selectExpr("k", "n", "n + 1 AS m")

    append_partitioned(rows, str(tmp_path / "t"), "k", ["m"], add)
    assert spark.conf.get(ADVISORY) == "8m" and seen == [["k", "n"]]
    assert rows_of(spark.read.parquet(str(tmp_path / "t")), "k", "m") == [("x", 2), ("y", 3)]
