"""Rows and digits that must not get lost."""

from __future__ import annotations

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from conftest import instant, landing_row, rows_of
from ledgerloom import schemas
from ledgerloom.functions.exact import exact_sum, is_inexact
from ledgerloom.operators.joins import version_number
from ledgerloom.plans.ingest import Warehouse, run_ingest
from ledgerloom.plans.testdata import account_id
from ledgerloom.sources import tables as S
from ledgerloom.streaming.ingest import ingest_stream

AT = instant("2026-02-01")


def test_long_account_numbers_stay_apart(spark):
    numbers = spark.createDataFrame([(7,), (15000,), (150000,)], "n long")
    assert rows_of(numbers.select(account_id(F.col("n")))) == [
        ("ACC-00007",), ("ACC-15000",), ("ACC-150000",)]


@pytest.mark.parametrize("values, total, inexact", [
    ([4e-7, 4e-7], 8e-7, False),
    ([0.1] * 10, 1.0, False),
    ([1e-15, 2e-15], 3e-15, False),
    ([3e-20, 4e-20], 7e-20, True),
    ([2.0**60, 2.0**60], 2.0**61, True),
    ([123456789.123456, 1e-9], 123456789.123456001, False),
])
def test_no_digit_is_rounded_away(spark, values, total, inexact):
    df = spark.createDataFrame([(v,) for v in values], "v double").repartition(3)
    row = df.agg(exact_sum(F.col("v")).alias("s"), is_inexact(F.col("v")).alias("i")).first()
    assert row.s == pytest.approx(total, rel=1e-12)
    assert row.i == inexact


def test_versions_without_key_or_date_are_numbered(spark):
    day = dt.datetime(2026, 1, 1)
    rows = [("a", day, 1), ("a", None, 2), (None, day, 3)]
    df = spark.createDataFrame(rows, "account_id string, valid_from timestamp, account_sk long")
    assert version_number(df).count() == 3


def test_streams_keep_each_others_rejects(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    for name in ("one", "two"):
        rows = [landing_row(transaction_id=name, currency="XXX")]
        spark.createDataFrame(rows, schemas.LANDING).write.parquet(str(tmp_path / name))
        ingest_stream(spark, str(tmp_path / name), house, str(tmp_path / f"seen-{name}")
                      ).awaitTermination()
    assert house.quarantine().count() == 2


def test_replacing_a_partition_needs_no_session_setting(spark, tmp_path):
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "static")
    path = str(tmp_path / "t")
    for run in ("a", "b"):
        df = spark.range(2).withColumn("run", F.lit(run))
        S.replace_partitions(df, path, "run")
    assert spark.read.parquet(path).count() == 4


def test_csv_keeps_odd_text_and_microseconds(spark, tmp_path):
    odd = ["two\nlines", ' "quoted", ', "  blanks  ", "back\\slash", "a,b"]
    rows = [
        landing_row(transaction_id=str(i), merchant_name=text,
                    timestamp=dt.datetime(2026, 1, 1, 1, 2, 3, 456789, tzinfo=dt.UTC))
        for i, text in enumerate(odd)
    ]
    df = spark.createDataFrame(rows, schemas.LANDING)
    S.export(df, str(tmp_path / "out"), "csv")
    back = S.read_export(spark, str(tmp_path / "out"), "csv", schemas.LANDING)
    assert rows_of(back) == rows_of(df)


def test_rows_without_a_version_are_an_error(spark, tmp_path):
    first = S.publish(spark.range(3).toDF("x"), str(tmp_path / "t"))
    (tmp_path / "t" / "_log" / f"{1:010d}").unlink()
    with pytest.raises(RuntimeError, match="no version of it is committed"):
        S.latest(spark, str(tmp_path / "t"), first.schema)


def _place(tmp_path, spark):
    landing = tmp_path / "landing"
    landing.mkdir()
    return landing, Warehouse(spark, str(tmp_path / "house"))


def _write(spark, file, transaction_id):
    import pyarrow.parquet as pq

    df = spark.createDataFrame([landing_row(transaction_id=transaction_id)], schemas.LANDING)
    pq.write_table(df.toArrow(), file, compression="none")
    os.utime(file, (2_000_000, 2_000_000))


def test_content_changed_at_the_same_size_and_time_is_read(spark, tmp_path):
    landing, house = _place(tmp_path, spark)
    _write(spark, landing / "a.parquet", "id-1")
    run_ingest(house, str(landing), "r1", AT)
    _write(spark, landing / "a.parquet", "id-2")
    assert run_ingest(house, str(landing), "r2", AT, mode="stat").first().files_skipped == 1
    assert run_ingest(house, str(landing), "r3", AT).first().records_loaded == 1
    # One line for each run, as it ended.
    runs = house.runs("ingestion_runs", schemas.INGESTION_RUNS)
    assert rows_of(runs, "run_id", "status") == [
        ("r1", "completed"), ("r2", "completed"), ("r3", "completed")]


def test_file_names_are_the_same_everywhere(spark, tmp_path):
    landing, house = _place(tmp_path, spark)
    for number, name in enumerate(["a b.parquet", "c+d.parquet", "e%20f.parquet"]):
        _write(spark, landing / name, f"id-{number}")
    run_ingest(house, str(landing), "r1", AT)
    listed = house.published("file_manifest", schemas.FILE_MANIFEST)
    assert rows_of(house.transactions(), "source_file") == rows_of(listed, "file_path")
