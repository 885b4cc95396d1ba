from __future__ import annotations

import datetime as dt
import sys
from pathlib import Path

import pytest
from pyspark.sql import SparkSession

sys.path[:0] = [str(Path(__file__).parents[1]), str(Path(__file__).parent)]

from ledgerloom import configure, schemas  # noqa: E402

UTC = dt.UTC


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = (
        SparkSession.builder.master("local[4]")
        .appName("tests")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "4g")
        .config("spark.checkpoint.dir", str(tmp_path_factory.mktemp("shared")))
        .config("spark.sql.warehouse.dir", str(tmp_path_factory.mktemp("catalog")))
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("OFF")
    yield configure(session)
    session.stop()


def instant(text: str) -> dt.datetime:
    return dt.datetime.fromisoformat(text).replace(tzinfo=UTC)


# Five landing rows without fault: two accounts with two rows, one with one.
CLEAN = [
    ("ledger-0001", "2026-01-15 07:05", 18.40, "GBP", "Harbour Bakery", "Bread", "ACC-00001",
     "debit", "completed"),
    ("ledger-0002", "2026-01-15 19:50", 260.75, "JPY", "Night Train", "Travel", "ACC-00002",
     "debit", "completed"),
    ("ledger-0003", "2026-01-16 12:00", 3.10, "USD", "Corner Press", "News", "ACC-00001",
     "debit", "pending"),
    ("ledger-0004", "2026-01-16 16:45", 980.00, "EUR", "Lathe & Sons", "Tools", "ACC-00003",
     "debit", "completed"),
    ("ledger-0005", "2026-01-17 21:30", 71.20, "GBP", "Old Cinema", "Leisure", "ACC-00002",
     "credit", "completed"),
]


def landing_row(**changes) -> tuple:
    row = dict(zip(schemas.LANDING.names, CLEAN[0], strict=True)) | changes
    if isinstance(row["timestamp"], str):
        row["timestamp"] = instant(row["timestamp"])
    return tuple(row[name] for name in schemas.LANDING.names)


def landing_frame(spark, rows):
    return spark.createDataFrame(rows, schemas.LANDING)


# id, amount, currency, category, account, type, status, date
MODEL_ROWS = [
    ("m1", 12.0, "GBP", "Bread", "ACC-00001", "debit", "completed", "2026-01-10"),
    ("m2", 8.0, "GBP", "Bread", "ACC-00001", "debit", "completed", "2026-01-10"),
    ("m3", 40.0, "GBP", "Tools", "ACC-00001", "debit", "completed", "2026-01-11"),
    ("m4", 300.0, "GBP", "Wages", "ACC-00001", "credit", "completed", "2026-01-11"),
    ("m5", 7.0, "GBP", "Tools", "ACC-00001", "debit", "failed", "2026-01-11"),
    ("m6", 60.0, "USD", "Rent", "ACC-00002", "debit", "completed", "2026-01-10"),
    ("m7", 6.0, "USD", "Bread", "ACC-00002", "debit", "pending", "2026-01-11"),
    ("m8", 90.0, "USD", "Rent", "ACC-00002", "debit", "completed", "2026-02-02"),
    ("m9", 110.0, "JPY", "Wages", "ACC-00002", "credit", "completed", "2026-02-02"),
]


def staged_frame(spark, rows=MODEL_ROWS):
    from ledgerloom.operators.rows import staging

    full = [
        (i, instant(d), amount, cur, "Shop", cat, acc, kind, status, dt.date.fromisoformat(d),
         "file.parquet", instant("2026-02-02"), "run-1")
        for i, amount, cur, cat, acc, kind, status, d in rows
    ]
    return staging(spark.createDataFrame(full, schemas.TRANSACTIONS))


def rows_of(df, *columns):
    picked = df.select(*columns) if columns else df
    return sorted((tuple(r) for r in picked.collect()), key=repr)
