"""Builds over a loaded warehouse: marts, dimension, facts, checks and catalog."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Mapping
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.operators import catalog as C
from ledgerloom.operators import quality as Q
from ledgerloom.operators.joins import heavy_keys, pit_join
from ledgerloom.operators.marts import (
    DAILY_GRAIN,
    MONTHLY_GRAIN,
    daily_spend,
    monthly_account_summary,
)
from ledgerloom.operators.rows import staging
from ledgerloom.operators.runs import audit_row, check_result_rows, run_started
from ledgerloom.operators.scd2 import account_history, account_profiles, scd2_counts, scd2_step
from ledgerloom.operators.suite import CRITICAL, WARN, Check, run_suite, suite_status
from ledgerloom.plans.ingest import Warehouse
from ledgerloom.session import configure, scratch, stage
from ledgerloom.sources.files import delete
from ledgerloom.sources.tables import (
    KEPT,
    Version,
    commit,
    expire,
    has_version,
    head,
    read_partitioned,
    read_parts,
    write_part,
)

DAILY, MONTHLY, DIM, FCT = (
    "daily_spend_by_category",
    "monthly_account_summary",
    "dim_accounts",
    "fct_transactions",
)
#: The two parts of the dimension.
_CLOSED, _OPEN = "closed", "open"
#: Parts of closed versions; of more, the younger half is merged into one.
CLOSED_PARTS = 64


def stg_transactions(house: Warehouse) -> DataFrame:
    return staging(house.transactions())


def keyed(rows: DataFrame, dim: DataFrame) -> DataFrame:
    """Rows with the key of their account's version.

    The dimension itself tells which accounts own a large share of the facts.
    """
    heavy = heavy_keys(dim.where(F.col("is_current")), "account_id", "transaction_count")
    return pit_join(rows, dim, heavy=heavy)


def fact_table(stg: DataFrame, dim: DataFrame) -> DataFrame:
    """Facts keyed to account versions."""
    return keyed(stg, dim).select(*schemas.FACT_COLUMNS)


def build_models(house: Warehouse, run_id: str | None = None) -> DataFrame:
    """Rebuild both marts; one failed model does not stop the other."""
    spark = configure(house.spark)
    run_id, at, started = run_id or uuid.uuid4().hex, datetime.now(UTC), time.monotonic()
    house.log("transform_runs", run_started(spark, schemas.TRANSFORM_RUNS, run_id, at))

    models: dict[str, tuple[Callable[[DataFrame], DataFrame], list[str]]] = {
        DAILY: (daily_spend, DAILY_GRAIN),
        MONTHLY: (monthly_account_summary, MONTHLY_GRAIN),
    }
    errors = []
    for name, (model, grain) in models.items():
        try:
            house.publish(name, model(stg_transactions(house)), grain)
        except Exception as error:
            errors.append(f"{name}: {error}")
    row = audit_row(
        spark, schemas.TRANSFORM_RUNS, run_id=run_id, started_at=at,
        completed_at=datetime.now(UTC),
        status="failed" if len(errors) == len(models) else "completed",
        models_executed=len(models) - len(errors), models_failed=len(errors),
        elapsed_seconds=time.monotonic() - started, error_message="; ".join(errors) or None,
    )
    house.log("transform_runs", row)
    return row


def build_dimension(
    house: Warehouse, run_date: date, run_id: str | None = None, contiguous: bool = False
) -> DataFrame:
    """Merge today's profiles into the dimension; returns the run's counts.

    The new version is published only once it is complete, so a failed build
    leaves the dimension as it was.
    """
    spark = configure(house.spark)
    run_id, started = run_id or uuid.uuid4().hex, time.monotonic()
    with scratch(spark):
        profiles = stage(account_profiles(stg_transactions(house)), "profiles")
        remaining = _commit_build(house, profiles, run_date, run_id, contiguous)
        counts = scd2_counts(remaining, profiles, run_id).first()
    row = audit_row(
        spark, schemas.DIM_BUILD_RUNS, run_id=run_id,
        accounts_processed=counts.accounts_processed, new_versions=counts.new_versions,
        unchanged=counts.unchanged, elapsed_seconds=time.monotonic() - started,
        completed_at=datetime.now(UTC),
    )
    house.log("dim_build_runs", row)
    return row


def _commit_build(
    house: Warehouse, profiles: DataFrame, run_date: date, run_id: str, contiguous: bool
) -> DataFrame:
    """Write the versions a build ends and those open after it; returns the latter.

    The dimension is closed versions in parts that are only ever added, and one
    snapshot of the open ones.  A version of the table names both and the highest key
    given, so a build reads and writes open rows alone.  If another build was committed
    meanwhile, this one is made again on top of it.
    """
    spark, root, shape = house.spark, house.path(DIM), schemas.DIM_ACCOUNTS
    order = ["account_id", "valid_from"]
    while True:
        last = head(spark, root) or Version()
        held = read_parts(spark, root, last.folders(_OPEN), shape)
        top = last.notes.get("top", 0)
        ended, remaining = scd2_step(held, profiles, run_date, run_id, top, contiguous=contiguous)
        closed, written = list(last.folders(_CLOSED)), []
        ended = stage(ended, "ended")
        if ended.take(1):
            written.append(write_part(ended, root, order))
            closed.append(written[-1])
        if len(closed) > CLOSED_PARTS:
            young = closed[CLOSED_PARTS // 2 :]
            written.append(write_part(read_parts(spark, root, young, shape), root, order))
            closed = closed[: CLOSED_PARTS // 2] + written[-1:]
        written.append(write_part(remaining, root, order))
        after = read_parts(spark, root, written[-1:], shape)
        given = after.agg(F.max("account_sk").alias("top")).first().top or 0
        made = Version(
            last.number + 1, {_CLOSED: closed, _OPEN: written[-1:]}, {"top": max(top, given)}
        )
        if commit(spark, root, made):
            expire(spark, root, KEPT)
            return after
        for folder in written:
            delete(spark, f"{root}/{folder}")


def build_fact(house: Warehouse) -> DataFrame:
    dim = house.published(DIM, schemas.DIM_ACCOUNTS)
    return house.publish(FCT, fact_table(stg_transactions(house), dim))


def model_tables(house: Warehouse) -> dict[str, DataFrame]:
    """Readers of the tables built so far, each as last published."""
    stg = stg_transactions(house)
    dim = house.published(DIM, schemas.DIM_ACCOUNTS)
    shapes = {
        DAILY: daily_spend(stg).schema,
        MONTHLY: monthly_account_summary(stg).schema,
        # Of no rows: the join looks at the dimension before it is built.
        FCT: fact_table(stg.limit(0), dim.limit(0)).schema,
    }
    shapes[DIM] = schemas.DIM_ACCOUNTS
    built = {
        name: house.published(name, shape)
        for name, shape in shapes.items()
        if has_version(house.spark, house.path(name))
    }
    return built | {"stg_transactions": stg, "transactions": house.transactions()}


def warehouse_checks(
    tables: Mapping[str, DataFrame], as_of: datetime | Column | None = None
) -> list[Check]:
    """The thirteen standard checks.  A missing table makes only its checks fail to run."""
    t = tables
    return [
        Check("accepted_values_currency",
              lambda: Q.accepted_values_currency(t["stg_transactions"]),
              WARN, "Staged currencies are in the accepted set"),
        Check("dim_accounts_no_null_sk", lambda: Q.dim_accounts_no_null_sk(t[DIM]),
              CRITICAL, "Every account version has a surrogate key"),
        Check("dim_accounts_no_overlapping_ranges",
              lambda: Q.dim_accounts_no_overlapping_ranges(t[DIM]),
              CRITICAL, "Versions of an account do not overlap"),
        Check("dim_accounts_single_current", lambda: Q.dim_accounts_single_current(t[DIM]),
              CRITICAL, "An account has at most one current version"),
        Check("fct_no_null_account_sk", lambda: Q.fct_no_null_account_sk(t[FCT]),
              CRITICAL, "Every fact has an account key"),
        Check("fct_no_unknown_account_sk", lambda: Q.fct_no_unknown_account_sk(t[FCT]),
              WARN, "Facts match an account version"),
        Check("fct_row_count_matches_staging",
              lambda: Q.fct_row_count_matches_staging(t["stg_transactions"], t[FCT]),
              CRITICAL, "Facts and staging have the same number of rows"),
        Check("fct_unique_transaction_id", lambda: Q.fct_unique_transaction_id(t[FCT]),
              CRITICAL, "A transaction is one fact"),
        Check("freshness", lambda: Q.freshness(t["stg_transactions"], as_of),
              WARN, "The newest load is at most 48 hours old"),
        Check("mart_not_empty", lambda: Q.mart_not_empty(t[DAILY], t[MONTHLY], t[FCT]),
              CRITICAL, "Marts and facts have rows"),
        Check("row_count_staging",
              lambda: Q.row_count_staging(t["transactions"], t["stg_transactions"]),
              CRITICAL, "Staging has every raw row"),
        Check("unique_daily_spend_grain", lambda: Q.unique_daily_spend_grain(t[DAILY]),
              CRITICAL, "The daily mart has one row per grain"),
        Check("unique_monthly_summary_grain", lambda: Q.unique_monthly_summary_grain(t[MONTHLY]),
              CRITICAL, "The monthly mart has one row per grain"),
    ]


def check_warehouse(
    house: Warehouse,
    tables: Mapping[str, DataFrame] | None = None,
    run_id: str | None = None,
    as_of: datetime | None = None,
) -> DataFrame:
    """Run the checks, record results and run, and return the run's audit row."""
    spark = configure(house.spark)
    run_id, at, started = run_id or uuid.uuid4().hex, datetime.now(UTC), time.monotonic()
    house.log("check_runs", run_started(spark, schemas.CHECK_RUNS, run_id, at))
    results = run_suite(spark, warehouse_checks(tables or model_tables(house), as_of or at))
    house.log("check_results", check_result_rows(results, run_id))
    row = audit_row(
        spark, schemas.CHECK_RUNS, run_id=run_id, started_at=at,
        completed_at=datetime.now(UTC), elapsed_seconds=time.monotonic() - started,
        **suite_status(results).first().asDict(),
    )
    house.log("check_runs", row)
    return row


def build_catalog(
    house: Warehouse,
    at: datetime | None = None,
    metadata: DataFrame | None = None,
    columns_metadata: DataFrame | None = None,
    models: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Profile every table and rebuild both catalog tables as a whole.

    Business metadata is the caller's: frames of ``catalog.TABLE_METADATA``,
    ``catalog.COLUMN_METADATA`` and ``catalog.MODEL_METADATA``.
    """
    spark = configure(house.spark)
    metadata = C.no_metadata(spark) if metadata is None else metadata
    if columns_metadata is None:
        columns_metadata = C.no_metadata(spark, C.COLUMN_METADATA)
    tables = model_tables(house)
    if DIM in tables:
        tables["account_history"] = account_history(tables[DIM])
    tables["quarantine"] = house.quarantine()
    for name in ("ingestion_runs", "transform_runs", "dim_build_runs", "check_runs",
                 "check_results"):
        shape = getattr(schemas, name.upper())
        tables[name] = read_partitioned(spark, house.path(name), shape)
    views = {"stg_transactions", "account_history"}

    profile = C.overlay(C.table_profile(tables, views), metadata, models)
    stamped = profile.withColumn("last_built_at", F.lit(at or datetime.now(UTC)))
    columns = C.overlay_columns(C.column_profile(tables, views), columns_metadata)
    return (
        house.publish("catalog_tables", stamped.select(*schemas.CATALOG_TABLES.names)),
        house.publish("catalog_columns", columns.select(*schemas.CATALOG_COLUMNS.names)),
    )
