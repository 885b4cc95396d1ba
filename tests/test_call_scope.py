"""What a query costs does not depend on queries that ran before it."""

from ledgerloom.operators.quality import same_rows
from ledgerloom.plans import testdata as td
from ledgerloom.plans.registry import QUERIES
from ledgerloom.session import workspace
from ledgerloom.sources.files import child_names

from conftest import rows_of

SF_DIR = "/root/testdata/sf0.001"


def staged(spark, table):
    return sum(name.startswith(f"{table}-") for name in child_names(spark, workspace(spark)))


def test_calls_share_no_tables(spark):
    before = staged(spark, "dim_accounts")
    for _ in range(2):
        QUERIES["scd2_versions"](spark, SF_DIR)
    assert staged(spark, "dim_accounts") == before + 2


def test_a_single_pass_leaves_no_copy_of_the_rows(spark):
    before = staged(spark, "landing")
    QUERIES["daily_spend"](spark, SF_DIR).collect()
    assert staged(spark, "landing") == before


def test_order_lines_are_dealt_out_once(spark):
    with td.call(shared=False):
        plan = td.landing(spark, SF_DIR)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(l_orderkey") == 1
    assert "RoundRobin" not in plan and "REPARTITION" not in plan


def test_facts_no_check_reads_are_not_built(spark):
    before = staged(spark, "fct_transactions")
    QUERIES["suite_with_missing_table"](spark, SF_DIR).collect()
    assert staged(spark, "fct_transactions") == before


def test_samples_write_no_tables(spark):
    before = staged(spark, "fct_transactions"), staged(spark, "monthly_account_summary")
    QUERIES["check_samples"](spark, SF_DIR).collect()
    assert (staged(spark, "fct_transactions"), staged(spark, "monthly_account_summary")) == before


def test_tables_are_compared_in_one_grouping(spark):
    a = spark.createDataFrame([("x", 1), ("x", 1), ("x", 1), ("y", None), ("z", 2)], "k string, n int")
    b = spark.createDataFrame([(1, "x"), (None, "y"), (3, "w"), (3, "w")], "n int, k string")
    odd = same_rows(a, b)
    plan = odd._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert rows_of(odd) == sorted([
        ("x", 1, "first"), ("x", 1, "first"), ("z", 2, "first"), ("w", 3, "second"), ("w", 3, "second"),
    ], key=repr)


def test_streamed_files_follow_the_shuffle_partitions(spark):
    before = set(child_names(spark, workspace(spark)))
    QUERIES["stream_daily_spend"](spark, SF_DIR)
    new = set(child_names(spark, workspace(spark))) - before
    folder = next(name for name in new if name.startswith("staged_files-"))
    files = child_names(spark, f"{workspace(spark)}/{folder}")
    assert 0 < sum(name.endswith(".parquet") for name in files) <= 4
