"""Declared table schemas; nothing is inferred and nothing evolves."""

from __future__ import annotations

from pyspark.sql import types as T

_STRING, _LONG, _INT = T.StringType(), T.LongType(), T.IntegerType()
_DOUBLE, _BOOL, _DATE, _TS = (
    T.DoubleType(),
    T.BooleanType(),
    T.DateType(),
    T.TimestampType(),
)


def _struct(*fields: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields])


LANDING = _struct(
    ("transaction_id", _STRING),
    ("timestamp", _TS),
    ("amount", _DOUBLE),
    ("currency", _STRING),
    ("merchant_name", _STRING),
    ("category", _STRING),
    ("account_id", _STRING),
    ("transaction_type", _STRING),
    ("status", _STRING),
)

_LINEAGE = (
    ("transaction_date", _DATE),
    ("source_file", _STRING),
    ("ingested_at", _TS),
    ("run_id", _STRING),
)

TRANSACTIONS = T.StructType(LANDING.fields + _struct(*_LINEAGE).fields)

QUARANTINE = _struct(
    ("quarantine_id", _LONG),
    ("source_file", _STRING),
    ("record_data", _STRING),
    ("rejection_reason", _STRING),
    ("rejected_at", _TS),
    ("run_id", _STRING),
)

FILE_MANIFEST = _struct(
    ("file_path", _STRING),
    ("file_size_bytes", _LONG),
    ("file_hash", _STRING),
    ("file_mtime", _DOUBLE),
    ("run_id", _STRING),
    ("processed_at", _TS),
    ("status", _STRING),
    ("error_message", _STRING),
)

MANIFEST_METADATA = _struct(
    ("source_dir", _STRING), ("watermark_mtime", _DOUBLE), ("updated_at", _TS)
)

STAGING_COLUMNS = [
    "transaction_id",
    "transaction_timestamp",
    "transaction_date",
    "amount",
    "currency",
    "merchant_name",
    "category",
    "account_id",
    "transaction_type",
    "status",
    "source_file",
    "ingested_at",
    "run_id",
]

FACT_COLUMNS = STAGING_COLUMNS[:3] + ["account_sk", "account_id", "amount", "currency",
                                      "merchant_name", "category", "transaction_type",
                                      "status", "source_file", "ingested_at", "run_id"]

DIM_ACCOUNTS = _struct(
    ("account_sk", _LONG),
    ("account_id", _STRING),
    ("primary_currency", _STRING),
    ("primary_category", _STRING),
    ("transaction_count", _LONG),
    ("total_spend", _DOUBLE),
    ("first_seen", _DATE),
    ("last_seen", _DATE),
    ("row_hash", _STRING),
    ("valid_from", _TS),
    ("valid_to", _TS),
    ("is_current", _BOOL),
    ("run_id", _STRING),
)

INGESTION_RUNS = _struct(
    ("run_id", _STRING),
    ("started_at", _TS),
    ("completed_at", _TS),
    ("status", _STRING),
    ("files_processed", _LONG),
    ("records_loaded", _LONG),
    ("records_quarantined", _LONG),
    ("duplicates_skipped", _LONG),
    ("elapsed_seconds", _DOUBLE),
    ("files_checked", _LONG),
    ("files_skipped", _LONG),
    ("files_ingested", _LONG),
    ("files_failed", _LONG),
)

TRANSFORM_RUNS = _struct(
    ("run_id", _STRING),
    ("started_at", _TS),
    ("completed_at", _TS),
    ("status", _STRING),
    ("models_executed", _LONG),
    ("models_failed", _LONG),
    ("elapsed_seconds", _DOUBLE),
    ("error_message", _STRING),
)

DIM_BUILD_RUNS = _struct(
    ("run_id", _STRING),
    ("accounts_processed", _LONG),
    ("new_versions", _LONG),
    ("unchanged", _LONG),
    ("elapsed_seconds", _DOUBLE),
    ("completed_at", _TS),
)

CHECK_RUNS = _struct(
    ("run_id", _STRING),
    ("started_at", _TS),
    ("completed_at", _TS),
    ("status", _STRING),
    ("total_checks", _LONG),
    ("checks_passed", _LONG),
    ("checks_failed", _LONG),
    ("checks_errored", _LONG),
    ("elapsed_seconds", _DOUBLE),
    ("error_message", _STRING),
)

CHECK_RESULTS = _struct(
    ("id", _STRING),
    ("run_id", _STRING),
    ("check_name", _STRING),
    ("severity", _STRING),
    ("description", _STRING),
    ("status", _STRING),
    ("violation_count", _LONG),
    ("sample_violations", _STRING),
    ("elapsed_seconds", _DOUBLE),
    ("error_message", _STRING),
)

CATALOG_TABLES = _struct(
    ("table_name", _STRING),
    ("table_schema", _STRING),
    ("table_type", _STRING),
    ("zone", _STRING),
    ("description", _STRING),
    ("owner", _STRING),
    ("source_sql_file", _STRING),
    ("depends_on", _STRING),
    ("row_count", _LONG),
    ("column_count", _INT),
    ("last_built_at", _TS),
)

CATALOG_COLUMNS = _struct(
    ("id", _STRING),
    ("table_name", _STRING),
    ("column_name", _STRING),
    ("ordinal_position", _INT),
    ("data_type", _STRING),
    ("is_nullable", _BOOL),
    ("is_pk", _BOOL),
    ("description", _STRING),
    ("sample_values", _STRING),
)
