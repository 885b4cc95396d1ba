"""Aggregated marts and the analytics queries over them.

Every aggregate here combines map-side before its shuffle, so a hot group
reaches the reducers as one partial row per task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exact import exact_sum

DAILY_GRAIN = ["transaction_date", "category", "currency"]
MONTHLY_GRAIN = ["month", "account_id", "currency"]


def daily_spend(stg: DataFrame) -> DataFrame:
    """Completed debits per date, category and currency."""
    spend = stg.where((F.col("transaction_type") == "debit") & (F.col("status") == "completed"))
    totals = spend.groupBy(*DAILY_GRAIN).agg(
        exact_sum(F.col("amount")).alias("total_amount"),
        F.count("*").alias("transaction_count"),
    )
    return totals.withColumn("avg_amount", F.col("total_amount") / F.col("transaction_count"))


def monthly_account_summary(stg: DataFrame) -> DataFrame:
    """Completed debits, credits and their difference per month, account and currency."""

    def total(kind: str):
        return F.coalesce(
            exact_sum(F.col("amount"), F.col("transaction_type") == kind), F.lit(0.0)
        )

    totals = (
        stg.where(F.col("status") == "completed")
        .groupBy(F.trunc("transaction_date", "MM").alias("month"), "account_id", "currency")
        .agg(
            total("debit").alias("total_debits"),
            total("credit").alias("total_credits"),
            F.count("*").alias("transaction_count"),
        )
    )
    return totals.select(
        *MONTHLY_GRAIN,
        "total_debits",
        "total_credits",
        (F.col("total_credits") - F.col("total_debits")).alias("net_flow"),
        "transaction_count",
    )


def top_merchants(txn: DataFrame, n: int = 10) -> DataFrame:
    """Merchants with the highest debit total; names break ties."""
    totals = (
        txn.where(F.col("transaction_type") == "debit")
        .groupBy("merchant_name")
        .agg(
            exact_sum(F.col("amount")).alias("total_amount"),
            F.count("*").alias("transaction_count"),
        )
    )
    return totals.orderBy(F.desc("total_amount"), "merchant_name").limit(n)


def currency_breakdown(txn: DataFrame) -> DataFrame:
    """Count, total and rounded average per currency."""
    totals = txn.groupBy("currency").agg(
        F.count("*").alias("transaction_count"),
        exact_sum(F.col("amount")).alias("total_amount"),
    )
    average = F.col("total_amount") / F.col("transaction_count")
    return totals.withColumn("avg_amount", F.round(average, 2)).orderBy(
        F.desc("total_amount"), "currency"
    )


def fact_summary(fct: DataFrame) -> DataFrame:
    """Activity per account version; facts of unknown versions form their own groups."""
    return fct.groupBy("account_sk", "account_id").agg(
        F.count("*").alias("transaction_count"),
        exact_sum(F.col("amount")).alias("total_amount"),
        F.min("transaction_date").alias("first_transaction"),
        F.max("transaction_date").alias("last_transaction"),
    )


def daily_activity(txn: DataFrame) -> DataFrame:
    """Count and total per transaction date."""
    return txn.groupBy("transaction_date").agg(
        F.count("*").alias("transaction_count"),
        exact_sum(F.col("amount")).alias("total_amount"),
    )


def lineage_counts(txn: DataFrame) -> DataFrame:
    """Rows per source file and run."""
    return txn.groupBy("source_file", "run_id").agg(F.count("*").alias("transaction_count"))


def daily_spend_report(mart: DataFrame) -> DataFrame:
    """The daily mart as charted."""
    columns = ["transaction_date", "category", "total_amount", "transaction_count"]
    return mart.orderBy(*DAILY_GRAIN).select(*columns)


def monthly_report(mart: DataFrame) -> DataFrame:
    """The monthly mart, newest month first."""
    return mart.orderBy(F.desc("month"), "account_id", "currency").select(
        *MONTHLY_GRAIN, "total_debits", "total_credits", "net_flow", "transaction_count"
    )
