"""Row-level steps: validation, quarantine, lineage, staging and date slices."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions import rules as R
from ledgerloom.functions.ordered import number_rows
from ledgerloom.functions.text import record_json
from ledgerloom.sources.landing import SOURCE_FILE, SOURCE_ROW

VALID, REASON, REASONS = "_is_valid", "_rejection_reason", "_reasons"


def validate(df: DataFrame, rules: Sequence[R.Rule] | None = None) -> DataFrame:
    """Judge every row: one narrow projection, no shuffle."""
    rules = R.transaction_rules() if rules is None else rules
    return df.withColumns({
        VALID: R.all_pass(rules),
        REASON: R.rejection_text(rules),
        REASONS: R.rejection_list(rules),
    })


def split(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Valid rows without the verdict columns, and rejected rows with them."""
    valid = df.where(F.col(VALID)).drop(VALID, REASON, REASONS)
    return valid, df.where(~F.col(VALID))


def quarantine_rows(
    invalid: DataFrame, run_id: str, at: datetime, columns: Sequence[str] | None = None
) -> DataFrame:
    """Rejected rows as text: the record as JSON and why it was rejected."""
    names = list(schemas.LANDING.names if columns is None else columns)
    return invalid.select(
        F.col(SOURCE_FILE),
        record_json(invalid.schema, names).alias("record_data"),
        F.col(REASON).alias("rejection_reason"),
        F.lit(at).cast("timestamp").alias("rejected_at"),
        F.lit(run_id).alias("run_id"),
        *(F.col(c) for c in ("quarantine_id",) if c in invalid.columns),
    )


def to_quarantine(invalid: DataFrame, run_id: str, at: datetime, start: int = 0) -> DataFrame:
    """Quarantine table rows, numbered after ``start`` in (file, row) order."""
    numbered = number_rows(invalid, [SOURCE_FILE, SOURCE_ROW], "quarantine_id", start)
    return quarantine_rows(numbered, run_id, at).select(*schemas.QUARANTINE.names)


def enrich(df: DataFrame, run_id: str, at: datetime) -> DataFrame:
    """Add date and lineage; ``source_file`` comes with the scan."""
    return df.withColumns({
        "transaction_date": F.to_date("timestamp"),
        "ingested_at": F.lit(at).cast("timestamp"),
        "run_id": F.lit(run_id),
    }).select(*schemas.TRANSACTIONS.names)


def staging(transactions: DataFrame) -> DataFrame:
    """The staging view: same rows, ``timestamp`` renamed."""
    renamed = transactions.withColumnRenamed("timestamp", "transaction_timestamp")
    return renamed.select(*schemas.STAGING_COLUMNS)


def date_slice(
    df: DataFrame, first: date | str, last: date | str, column: str = "transaction_date"
) -> DataFrame:
    """Rows of a closed date range; prunes partitions of a table laid out by date."""
    bounds = [F.lit(day).cast("date") for day in (first, last)]
    return df.where(F.col(column).between(*bounds))
