import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from conftest import instant, rows_of, staged_frame
from ledgerloom import schemas
from ledgerloom.operators import marts as A
from ledgerloom.operators import quality as Q
from ledgerloom.operators.suite import (
    CRITICAL,
    RESULTS,
    WARN,
    Check,
    run_suite,
    suite_status,
    count_and_sample,
)
from ledgerloom.plans.warehouse import fact_table, warehouse_checks

NOW = instant("2026-02-03")


@pytest.fixture(scope="module")
def healthy(spark):
    stg = staged_frame(spark)
    day = dt.date(2026, 1, 1)
    dim = spark.createDataFrame(
        [(n, acc, "USD", "Food", 5, 1.0, day, day, "h", instant("2026-01-01"), None, True, "r")
         for n, acc in ((1, "ACC-00001"), (2, "ACC-00002"))], schemas.DIM_ACCOUNTS)
    return {
        "transactions": stg, "stg_transactions": stg,
        "daily_spend_by_category": A.daily_spend(stg),
        "monthly_account_summary": A.monthly_account_summary(stg),
        "dim_accounts": dim, "fct_transactions": fact_table(stg, dim),
    }


def failing(spark, tables, now=NOW):
    results = run_suite(spark, warehouse_checks(tables, now))
    return {r.check_name: r for r in results.where("status != 'pass'").collect()}


def doubled(df):
    return df.unionByName(df.limit(1))


def test_healthy_warehouse_passes(spark, healthy):
    results = run_suite(spark, warehouse_checks(healthy, NOW))
    assert results.count() == 13
    assert results.where("status != 'pass'").count() == 0
    assert tuple(suite_status(results).first()) == (13, 13, 0, 0, "passed")


FAULTS = {
    "mart_not_empty": lambda t: {
        "daily_spend_by_category": t["daily_spend_by_category"].limit(0)},
    "unique_daily_spend_grain": lambda t: {
        "daily_spend_by_category": doubled(t["daily_spend_by_category"])},
    "unique_monthly_summary_grain": lambda t: {
        "monthly_account_summary": doubled(t["monthly_account_summary"])},
    "accepted_values_currency": lambda t: {
        "stg_transactions": t["stg_transactions"].withColumn("currency", F.lit("XYZ"))},
    "row_count_staging": lambda t: {"transactions": doubled(t["transactions"])},
    "fct_unique_transaction_id": lambda t: {
        "fct_transactions": doubled(t["fct_transactions"].limit(8))},
    "fct_no_null_account_sk": lambda t: {
        "fct_transactions": t["fct_transactions"].withColumn(
            "account_sk", F.lit(None).cast("long"))},
    "fct_no_unknown_account_sk": lambda t: {
        "fct_transactions": t["fct_transactions"].withColumn(
            "account_sk", F.lit(-1).cast("long"))},
    "fct_row_count_matches_staging": lambda t: {"fct_transactions": t["fct_transactions"].limit(8)},
    "dim_accounts_single_current": lambda t: {
        "dim_accounts": t["dim_accounts"].unionByName(
            t["dim_accounts"].limit(1).withColumn("valid_from", F.lit(instant("2026-03-01"))))},
    "dim_accounts_no_overlapping_ranges": lambda t: {
        "dim_accounts": t["dim_accounts"].withColumn("account_id", F.lit("A")).withColumn(
            "is_current", F.lit(False))},
    "dim_accounts_no_null_sk": lambda t: {
        "dim_accounts": t["dim_accounts"].withColumn("account_sk", F.lit(None).cast("long"))},
}


@pytest.mark.parametrize("name", FAULTS)
def test_fault_is_found(spark, healthy, name):
    found = failing(spark, healthy | FAULTS[name](healthy))
    assert set(found) == {name}
    assert found[name].status == "fail"
    assert 1 <= len(json.loads(found[name].sample_violations)) <= 5


def test_stale_load_is_found(spark, healthy):
    assert set(failing(spark, healthy, instant("2026-02-05"))) == {"freshness"}
    assert failing(spark, healthy, instant("2026-02-04")) == {}
    empty = healthy["stg_transactions"].limit(0)
    assert Q.freshness(empty, NOW).count() == 0


def test_null_is_an_accepted_value(spark):
    df = spark.createDataFrame([("USD",), (None,), ("X",)], "c string")
    assert rows_of(Q.accepted(df, "c", ["USD"])) == [("X",)]


def test_missing_table_is_an_error_not_a_crash(spark, healthy):
    tables = {k: v for k, v in healthy.items() if k != "monthly_account_summary"}
    found = failing(spark, tables)
    assert {n: r.status for n, r in found.items()} == {
        "mart_not_empty": "error", "unique_monthly_summary_grain": "error"}
    assert all(r.violation_count == 0 and r.error_message for r in found.values())


def test_execution_failure_is_an_error(spark):
    def explode():
        return spark.range(1).where(F.raise_error(F.lit("boom")).isNull())

    checks = [Check("bad", explode), Check("good", lambda: spark.range(0))]
    got = {r.check_name: r for r in run_suite(spark, checks).collect()}
    assert got["bad"].status == "error"
    assert "boom" in got["bad"].error_message
    assert got["good"].status == "pass"


def test_samples_are_at_most_five(spark):
    check = Check("many", lambda: spark.range(100).select("id", F.lit(None).alias("note")),
                  CRITICAL, "too many")
    row = run_suite(spark, [check]).first()
    assert row.violation_count == 100
    samples = json.loads(row.sample_violations)
    assert len(samples) == 5
    assert set(samples[0]) == {"id", "note"}
    assert [s["id"] for s in samples] == ["0", "1", "10", "11", "12"]
    assert count_and_sample(spark.range(100).where("id < 0")) == (0, None)
    assert count_and_sample(spark.range(100).limit(0)) == (0, None)


@pytest.mark.parametrize(("outcomes", "expected"), [
    ([], "passed"),
    ([("pass", CRITICAL), ("pass", WARN)], "passed"),
    ([("fail", WARN)], "warn"),
    ([("error", CRITICAL)], "warn"),
    ([("error", WARN), ("fail", CRITICAL)], "failed"),
])
def test_suite_status(spark, outcomes, expected):
    rows = [(f"c{i}", sev, "", st, 0, None, 0.0, None) for i, (st, sev) in enumerate(outcomes)]
    assert suite_status(spark.createDataFrame(rows, RESULTS)).first().status == expected


def test_share_within(spark):
    df = spark.createDataFrame([("a",)] * 6 + [("b",)] * 4, "v string")
    assert Q.share_within(df, "v", {"a": 0.6, "b": 0.4}, 0.03).count() == 0
    off = Q.share_within(df, "v", {"a": 0.9, "c": 0.1}, 0.05)
    assert rows_of(off, "v") == [("a",), ("b",), ("c",)]


def test_same_rows_counts_multiplicity(spark):
    a = spark.createDataFrame([(1,), (1,), (2,)], "x int")
    b = spark.createDataFrame([(1,), (2,), (3,)], "x int")
    assert rows_of(Q.same_rows(a, b)) == [(1, "first"), (3, "second")]
    assert Q.same_rows(a, a).count() == 0


def test_marts_are_repeatable(spark, healthy):
    stg = healthy["stg_transactions"]
    assert Q.daily_spend_matches(stg, healthy["daily_spend_by_category"]).count() == 0
    assert Q.monthly_summary_matches(stg, healthy["monthly_account_summary"]).count() == 0


def test_shape_violations(spark):
    flat = spark.createDataFrame([(float(v),) for v in range(-3, 30)], "x double")
    assert Q.shape_violations(flat, "x").count() == 1
    skewed = spark.createDataFrame([(1.0,)] * 50 + [(500.0,)], "x double")
    assert Q.shape_violations(skewed, "x").count() == 0


def test_dimension_has_no_personal_columns(spark):
    names = [("dim_accounts", n) for n in schemas.DIM_ACCOUNTS.names] + [("people", "Email_2")]
    df = spark.createDataFrame(names, "table_name string, column_name string")
    assert Q.column_names(df, "dim_accounts").count() == 0
    assert rows_of(Q.column_names(df)) == [("people", "Email_2")]
    assert len(schemas.DIM_ACCOUNTS.names) == 13
