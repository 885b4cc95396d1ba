"""Data-quality checks.  A check is a DataFrame of violations: no rows, no problem."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.operators.distribution import shape, value_shares
from ledgerloom.operators.joins import overlapping_pairs
from ledgerloom.operators.marts import (
    DAILY_GRAIN,
    MONTHLY_GRAIN,
    daily_spend,
    monthly_account_summary,
)

# --- reusable forms ---------------------------------------------------------


def unique(df: DataFrame, keys: Sequence[str], count: str = "row_count") -> DataFrame:
    """Key values held by more than one row."""
    return df.groupBy(*keys).agg(F.count("*").alias(count)).where(F.col(count) > 1)


def not_null(df: DataFrame, column: str, show: Sequence[str] | None = None) -> DataFrame:
    return df.where(F.col(column).isNull()).select(*(show or df.columns))


def not_value(df: DataFrame, column: str, value, show: Sequence[str] | None = None) -> DataFrame:
    """Rows that hold a sentinel value."""
    return df.where(F.col(column) == F.lit(value)).select(*(show or df.columns))


def accepted(
    df: DataFrame, column: str, values: Sequence, show: Sequence[str] | None = None
) -> DataFrame:
    """Rows outside the accepted values; NULL is not a violation."""
    return df.where(~F.col(column).isin(*values)).select(*(show or df.columns))


def fresh(
    df: DataFrame,
    column: str,
    max_age: timedelta,
    as_of: datetime | Column | None = None,
    latest: str = "latest",
) -> DataFrame:
    """One row when the newest value is older than ``max_age``; none for an empty table."""
    if as_of is None:
        as_of = F.current_timestamp()
    now = as_of if isinstance(as_of, Column) else F.lit(as_of)
    limit = int(max_age.total_seconds())
    age = F.unix_timestamp(now) - F.unix_timestamp(latest)
    return (
        df.agg(F.max(column).alias(latest))
        .where(F.col(latest) < now - F.make_dt_interval(secs=F.lit(limit)))
        .select(
            latest,
            age.alias("staleness_seconds"),
            F.lit(limit).cast("long").alias("threshold_seconds"),
        )
    )


def _count(df: DataFrame) -> Column:
    return df.agg(F.count("*")).scalar()


def _one_row(df: DataFrame) -> DataFrame:
    return df.sparkSession.range(1)


def row_count_match(
    a: DataFrame, b: DataFrame, a_count: str = "a_count", b_count: str = "b_count"
) -> DataFrame:
    """One row with both counts when two tables differ in size."""
    counts = _one_row(a).select(_count(a).alias(a_count), _count(b).alias(b_count))
    return counts.where(F.col(a_count) != F.col(b_count))


def not_empty(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Names of tables without rows."""
    counts = [
        df.agg(F.count("*").alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count"
        )
        for name, df in tables.items()
    ]
    return reduce(DataFrame.unionByName, counts).where(F.col("row_count") == 0)


def no_overlap(dim: DataFrame, **columns: str) -> DataFrame:
    return overlapping_pairs(dim, **columns)


def single_current(dim: DataFrame, key: str = "account_id") -> DataFrame:
    """Keys with more than one current version."""
    return unique(dim.where(F.col("is_current")), [key], "current_count")


def share_within(
    df: DataFrame, column: str, expected: Mapping[str, float], tolerance: float
) -> DataFrame:
    """Values whose share is off by the tolerance or more, expected but missing ones included."""
    wanted = F.explode(
        F.array(*(
            F.struct(F.lit(v).alias(column), F.lit(float(s)).alias("expected_share"))
            for v, s in expected.items()
        ))
    )
    targets = _one_row(df).select(wanted.alias("t")).select("t.*")
    found = value_shares(df, column).join(targets, column, "full_outer")
    share = F.coalesce("share", F.lit(0.0))
    target = F.coalesce("expected_share", F.lit(0.0))
    return found.select(
        column, share.alias("share"), target.alias("expected_share")
    ).where(F.abs(F.col("share") - F.col("expected_share")) >= tolerance)


def shape_violations(df: DataFrame, column: str, min_skewness: float = 1.0) -> DataFrame:
    """One row when a positive, right-skewed amount does not look like one."""
    return shape(df, column).where(
        ~(F.col("skewness") > min_skewness)
        | ~(F.col("median") < F.col("mean"))
        | (F.col("non_positive") > 0)
    )


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows, with multiplicity, found in only one of two tables.

    Both are counted in one grouping, a row of the second as less than none.
    """
    both = a.withColumn("_count", F.lit(1)).unionByName(
        b.select(*a.columns).withColumn("_count", F.lit(-1))
    )
    odd = both.groupBy(*a.columns).agg(F.sum("_count").alias("_count")).where(F.col("_count") != 0)
    times = F.explode(F.sequence(F.lit(1), F.abs("_count"))).alias("_copy")
    found_in = F.when(F.col("_count") > 0, "first").otherwise("second").alias("found_in")
    return odd.select(*a.columns, found_in, times).drop("_copy")


def column_names(catalog_columns: DataFrame, table: str | None = None) -> DataFrame:
    """Columns whose name hints at personal data."""
    # Name fragments that hint at personal data.
    fragments = "name|email|phone|ssn|dob|birth|address|social"
    rows = catalog_columns
    if table is not None:
        rows = rows.where(F.col("table_name") == table)
    return rows.where(F.lower("column_name").rlike(fragments)).select("table_name", "column_name")


# --- row conformance of the raw table ---------------------------------------


def row_conformance(txn: DataFrame) -> DataFrame:
    """Violations per rule over stored rows, from one scan; rules without any are left out."""
    derived = [R.Rule(f"{c} is null", F.col(c).isNotNull())
               for c in ("transaction_date", "source_file", "ingested_at", "run_id")]
    dated = R.Rule(
        "transaction_date differs from timestamp",
        F.to_date("timestamp") == F.col("transaction_date"),
    )
    failures = R.rejection_list([*R.transaction_rules(), *derived, dated])
    return (
        txn.select(F.explode(failures).alias("rule"))
        .groupBy("rule")
        .agg(F.count("*").alias("violation_count"))
    )


def run_per_file(txn: DataFrame) -> DataFrame:
    """Files whose rows carry more than one run."""
    return (
        txn.groupBy("source_file")
        .agg(F.count_distinct("run_id").alias("run_count"))
        .where(F.col("run_count") > 1)
    )


def run_totals_match(txn: DataFrame, runs: DataFrame) -> DataFrame:
    """One row when the runs' loaded totals differ from the rows stored."""
    logged = runs.agg(F.coalesce(F.sum("records_loaded"), F.lit(0))).scalar()
    counts = _one_row(txn).select(logged.alias("logged"), _count(txn).alias("stored"))
    return counts.where(F.col("logged") != F.col("stored"))


def daily_spend_matches(stg: DataFrame, mart: DataFrame) -> DataFrame:
    """Rows in which the daily mart and its recomputation differ."""
    return same_rows(mart, daily_spend(stg))


def monthly_summary_matches(stg: DataFrame, mart: DataFrame) -> DataFrame:
    """Rows in which the monthly mart and its recomputation differ."""
    return same_rows(mart, monthly_account_summary(stg))


# --- the warehouse suite ----------------------------------------------------
# The names of checks and of the columns they return.


def row_count_staging(transactions: DataFrame, stg: DataFrame) -> DataFrame:
    found = row_count_match(transactions, stg, "source_count", "staging_count")
    return found.select(
        F.lit("stg_transactions").alias("check_target"), "source_count", "staging_count"
    )


def mart_not_empty(daily: DataFrame, monthly: DataFrame, fct: DataFrame) -> DataFrame:
    return not_empty({
        "daily_spend_by_category": daily,
        "monthly_account_summary": monthly,
        "fct_transactions": fct,
    })


def freshness(stg: DataFrame, as_of: datetime | Column | None = None) -> DataFrame:
    return fresh(stg, "ingested_at", timedelta(hours=48), as_of, "latest_ingested_at")


def unique_daily_spend_grain(daily: DataFrame) -> DataFrame:
    return unique(daily, DAILY_GRAIN)


def unique_monthly_summary_grain(monthly: DataFrame) -> DataFrame:
    return unique(monthly, MONTHLY_GRAIN)


def accepted_values_currency(stg: DataFrame) -> DataFrame:
    return accepted(stg, "currency", R.CURRENCIES, ["transaction_id", "currency"])


#: All that the checks read of facts.
FACT_KEYS = ["transaction_id", "account_id", "account_sk"]


def fct_unique_transaction_id(fct: DataFrame) -> DataFrame:
    return unique(fct, ["transaction_id"], "occurrence_count")


def fct_no_null_account_sk(fct: DataFrame) -> DataFrame:
    return not_null(fct, "account_sk", FACT_KEYS)


def fct_no_unknown_account_sk(fct: DataFrame) -> DataFrame:
    return not_value(fct, "account_sk", -1, FACT_KEYS)


def fct_row_count_matches_staging(stg: DataFrame, fct: DataFrame) -> DataFrame:
    found = row_count_match(stg, fct, "stg_count", "fct_count")
    return found.select(
        F.lit("row_count_mismatch").alias("check_detail"),
        "stg_count",
        "fct_count",
        (F.col("stg_count") - F.col("fct_count")).alias("difference"),
    )


def dim_accounts_single_current(dim: DataFrame) -> DataFrame:
    return single_current(dim)


def dim_accounts_no_overlapping_ranges(dim: DataFrame) -> DataFrame:
    return no_overlap(dim)


def dim_accounts_no_null_sk(dim: DataFrame) -> DataFrame:
    return not_null(dim, "account_sk", ["account_id", "valid_from"])
