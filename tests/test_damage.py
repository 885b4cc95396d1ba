"""Files that break while they are read, in runs and in streams."""

from __future__ import annotations

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import instant, landing_row, rows_of
from ledgerloom import schemas
from ledgerloom.plans.ingest import Warehouse, run_ingest
from ledgerloom.streaming.ingest import ingest_stream

AT = instant("2026-02-01")


def write(spark, file, ids, break_pages=False):
    df = spark.createDataFrame([landing_row(transaction_id=i) for i in ids], schemas.LANDING)
    pq.write_table(df.toArrow(), file, compression="none", use_dictionary=False, row_group_size=10)
    if break_pages:
        groups = pq.ParquetFile(file).metadata
        at = groups.row_group(groups.num_row_groups - 1).column(0).data_page_offset
        data = bytearray(file.read_bytes())
        data[at : at + 24] = b"\xff" * 24
        file.write_bytes(bytes(data))


def ids(name, n=25):
    return [f"{name}-{i}" for i in range(n)]


@pytest.fixture
def place(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    write(spark, landing / "a.parquet", ids("a"))
    write(spark, landing / "b.parquet", ids("b"), break_pages=True)
    write(spark, landing / "c.parquet", [*ids("c"), *ids("a", 3)])
    (landing / "d.parquet").write_bytes(b"PAR1 no footer PAR1")
    pq.write_table(spark.range(3).toArrow(), landing / "e.parquet")
    return landing, Warehouse(spark, str(tmp_path / "house"))


def state(house):
    manifest = house.published("file_manifest", schemas.FILE_MANIFEST)
    return (
        rows_of(house.transactions(), "transaction_id", "source_file"),
        rows_of(manifest, "file_path", "file_hash", "status", "error_message"),
        rows_of(house.quarantine(), "quarantine_id", "record_data"),
    )


def test_a_file_with_broken_pages_fails_alone(spark, place):
    landing, house = place
    row = run_ingest(house, str(landing), "r1", AT).first()
    assert (row.records_loaded, row.duplicates_skipped) == (50, 3)
    assert (row.files_processed, row.files_ingested, row.files_failed) == (5, 2, 3)
    assert house.transactions().where("source_file = 'b.parquet'").count() == 0
    manifest = house.published("file_manifest", schemas.FILE_MANIFEST)
    errors = {r.file_path: r.error_message for r in manifest.where("status = 'failed'").collect()}
    assert errors["b.parquet"].startswith("Damaged file: ")
    assert errors["b.parquet"].endswith(" of 25 rows could be read")
    assert set(errors) == {"b.parquet", "d.parquet", "e.parquet"}
    # Mended, it is read by the next run.
    write(spark, landing / "b.parquet", ids("b"))
    row = run_ingest(house, str(landing), "r2", AT).first()
    assert (row.records_loaded, row.files_ingested) == (25, 1)
    assert house.transactions().count() == 75


def test_a_stream_over_bad_files_gives_the_tables_of_the_run(spark, place, tmp_path):
    landing, house = place
    run_ingest(house, str(landing), "r1", AT)
    streamed = Warehouse(spark, str(tmp_path / "streamed"))
    ingest_stream(spark, str(landing), streamed, str(tmp_path / "progress")).awaitTermination()
    assert state(streamed) == state(house)
    run = streamed.runs("ingestion_runs", schemas.INGESTION_RUNS).first()
    assert (run.files_checked, run.files_ingested, run.files_failed) == (5, 2, 3)
    # What the stream has recorded, a run does not read again, and the other way round.
    again = run_ingest(streamed, str(landing), "r2", AT).first()
    assert (again.files_skipped, again.records_loaded) == (2, 0)
    write(spark, landing / "f.parquet", ids("f"))
    run_ingest(streamed, str(landing), "r3", AT)
    ingest_stream(spark, str(landing), streamed, str(tmp_path / "progress")).awaitTermination()
    assert streamed.transactions().groupBy("transaction_id").count().where(F.col("count") > 1).count() == 0
    assert streamed.transactions().count() == 75
