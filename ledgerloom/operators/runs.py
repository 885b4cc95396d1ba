"""Audit rows of runs, and the queries over them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas
from ledgerloom.operators.joins import latest_row, latest_run_rows


def audit_row(spark: SparkSession, schema: T.StructType, **values) -> DataFrame:
    """One audit row; columns not given are NULL."""
    unknown = set(values) - set(schema.names)
    if unknown:
        raise ValueError(f"not in the audit table: {sorted(unknown)}")
    return spark.createDataFrame([tuple(values.get(name) for name in schema.names)], schema)


def run_started(
    spark: SparkSession, schema: T.StructType, run_id: str, at: datetime
) -> DataFrame:
    """The event of a run that has begun; all counters are zero."""
    zeros = {f.name: 0 for f in schema if isinstance(f.dataType, T.LongType)}
    return audit_row(spark, schema, run_id=run_id, started_at=at, status="running", **zeros)


def latest_events(runs: DataFrame) -> DataFrame:
    """The state of each run: its completion where there is one, else its start."""
    done = F.struct(
        F.col("completed_at").isNotNull().alias("done"), *(F.col(c) for c in runs.columns)
    )
    return runs.groupBy("run_id").agg(F.max(done).alias("r")).select(
        *(F.col(f"r.{c}").alias(c) for c in runs.columns)
    )


def latest_ingestion(runs: DataFrame) -> DataFrame:
    return latest_row(runs).select("status", "records_loaded", "started_at")


def latest_ingestion_detail(runs: DataFrame) -> DataFrame:
    return latest_row(runs).select(
        "run_id", "started_at", "status", "records_loaded", "records_quarantined",
        "duplicates_skipped", "elapsed_seconds",
    )


def latest_transform(runs: DataFrame) -> DataFrame:
    return latest_row(runs).select("status", "models_executed", "started_at")


def latest_check(runs: DataFrame) -> DataFrame:
    return latest_row(runs).select("status", "checks_passed", "total_checks", "started_at")


def latest_check_summary(runs: DataFrame) -> DataFrame:
    return latest_row(runs).select(
        "run_id", "started_at", "status", "total_checks", "checks_passed", "checks_failed",
        "checks_errored", F.round("elapsed_seconds", 2).alias("elapsed_seconds"),
    )


def timeline(ingest: DataFrame, models: DataFrame, checks: DataFrame) -> DataFrame:
    """All runs in one list, newest first, each with its headline number as text."""

    def part(runs: DataFrame, kind: str, *metric) -> DataFrame:
        return runs.select(
            F.lit(kind).alias("run_type"),
            "run_id",
            "started_at",
            "status",
            F.concat(*metric).alias("key_metric"),
            F.round("elapsed_seconds", 2).alias("elapsed_seconds"),
        )

    every = (
        part(ingest, "ingestion", "records_loaded", F.lit(" records"))
        .unionByName(part(models, "transform", "models_executed", F.lit(" models")))
        .unionByName(
            part(checks, "check", "checks_passed", F.lit("/"), "total_checks", F.lit(" passed"))
        )
    )
    return every.orderBy(F.desc("started_at"), "run_type", "run_id")


def ingestion_history(runs: DataFrame) -> DataFrame:
    return runs.orderBy(F.desc("started_at"), "run_id").select(
        "run_id", "started_at", "status", "files_processed", "records_loaded",
        "records_quarantined", "duplicates_skipped",
        F.round("elapsed_seconds", 2).alias("elapsed_seconds"),
    )


def records_trend(runs: DataFrame) -> DataFrame:
    columns = ["started_at", "records_loaded", "records_quarantined", "duplicates_skipped"]
    return runs.orderBy("started_at").select(*columns)


def latest_check_results(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Results of the newest check run."""
    return latest_run_rows(results, runs).orderBy("severity", "check_name").select(
        "check_name", "severity", "status", "violation_count", "description"
    )


def check_outcomes(runs: DataFrame) -> DataFrame:
    columns = ["started_at", "checks_passed", "checks_failed", "checks_errored"]
    return runs.orderBy("started_at").select(*columns)


def all_check_results(results: DataFrame) -> DataFrame:
    return results.orderBy(F.desc("run_id"), "check_name").select(
        "run_id", "check_name", "severity", "status", "violation_count",
        F.round("elapsed_seconds", 4).alias("elapsed_seconds"),
    )


def check_result_rows(results: DataFrame, run_id: str) -> DataFrame:
    """Suite results as audit rows, with an id per run and check."""
    return results.select(
        F.sha2(F.concat_ws("/", F.lit(run_id), "check_name"), 256).alias("id"),
        F.lit(run_id).alias("run_id"),
        "*",
    ).select(*schemas.CHECK_RESULTS.names)
