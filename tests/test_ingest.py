import datetime as dt
import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from conftest import CLEAN, instant, landing_row, rows_of
from ledgerloom import schemas
from ledgerloom.plans.ingest import Warehouse, run_ingest
from ledgerloom.sources import manifest as M
from ledgerloom.sources.landing import (
    hash_files,
    landing_files,
    read_audited,
    read_transactions,
    schema_errors,
)

ARROW = pa.schema([
    (f.name, pa.timestamp("us", "UTC") if f.name == "timestamp"
     else pa.float64() if f.name == "amount" else pa.string())
    for f in schemas.LANDING
])
CLEAN_ROWS = [
    landing_row(**dict(zip(schemas.LANDING.names, row, strict=True))) for row in CLEAN
]
AT = instant("2026-02-01")


def write(folder, name, rows, schema=ARROW, mtime=None):
    columns = list(zip(*rows, strict=True))
    arrays = [pa.array(c, type=f.type) for c, f in zip(columns, schema, strict=True)]
    path = folder / name
    pq.write_table(pa.Table.from_arrays(arrays, schema=schema), path)
    if mtime is not None:
        os.utime(path, (mtime, mtime))
    return path


@pytest.fixture
def place(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    return landing, Warehouse(spark, str(tmp_path / "house"))


def run(place, run_id, **options):
    landing, house = place
    row = run_ingest(house, str(landing), run_id, AT, **options).first()
    assert row.status == "completed"
    return row


def loaded(row):
    return row.records_loaded, row.records_quarantined, row.duplicates_skipped


def test_full_refresh_skips_known_ids(place):
    write(place[0], "a.parquet", CLEAN_ROWS)
    assert loaded(run(place, "r1")) == (5, 0, 0)
    assert loaded(run(place, "r2", full_refresh=True)) == (0, 0, 5)
    assert place[1].transactions().count() == 5


def test_repeats_in_one_file(place):
    write(place[0], "a.parquet", CLEAN_ROWS + CLEAN_ROWS[:2])
    assert loaded(run(place, "r1")) == (5, 0, 2)


def test_repeats_across_files(place):
    write(place[0], "b.parquet", CLEAN_ROWS)
    write(place[0], "a.parquet", CLEAN_ROWS[:3])
    row = run(place, "r1")
    assert loaded(row) == (5, 0, 3)
    assert row.files_processed == 2
    assert rows_of(place[1].transactions().groupBy("source_file").count()) == [
        ("a.parquet", 3), ("b.parquet", 2)]


def test_invalid_rows_are_quarantined(place):
    rows = [landing_row(transaction_id="valid-001"), landing_row(transaction_id="valid-002"),
            landing_row(transaction_id="i1", amount=-5.0),
            landing_row(transaction_id="i2", currency="XXX"),
            landing_row(transaction_id="i3", status="invalid_status")]
    write(place[0], "a.parquet", rows)
    assert loaded(run(place, "r1")) == (2, 3, 0)
    bad = place[1].quarantine().orderBy("quarantine_id").collect()
    assert [r.quarantine_id for r in bad] == [1, 2, 3]
    assert [json.loads(r.record_data)["transaction_id"] for r in bad] == ["i1", "i2", "i3"]
    assert {(r.source_file, r.run_id) for r in bad} == {("a.parquet", "r1")}
    assert "currency not in allowed values" in bad[1].rejection_reason
    # Rejected rows are appended again by a full refresh, with new numbers.
    assert loaded(run(place, "r2", full_refresh=True)) == (0, 3, 2)
    assert rows_of(place[1].quarantine(), "quarantine_id") == [(n,) for n in range(1, 7)]


def test_validation_comes_before_dedup(place):
    rows = [landing_row(transaction_id="x", amount=-1.0), landing_row(transaction_id="x")]
    write(place[0], "a.parquet", rows)
    assert loaded(run(place, "r1")) == (1, 1, 0)


def test_bad_files_fail_alone(place):
    landing, house = place
    write(landing, "good.parquet", CLEAN_ROWS)
    wrong = pa.schema([("wrong_column", pa.string()), ("another_wrong", pa.string())])
    write(landing, "wrong.parquet", [("a", "b")], wrong)
    (landing / "broken.parquet").write_bytes(b"not parquet")
    row = run(place, "r1")
    assert (row.files_processed, row.files_ingested, row.files_failed) == (3, 1, 2)
    assert loaded(row) == (5, 0, 0)
    states = {r.file_path: r for r in house.published("file_manifest", schemas.FILE_MANIFEST)
              .collect()}
    assert {n: r.status for n, r in states.items()} == {
        "good.parquet": "success", "wrong.parquet": "failed", "broken.parquet": "failed"}
    assert states["wrong.parquet"].error_message == (
        "Missing columns: ['account_id', 'amount', 'category', 'currency', 'merchant_name', "
        "'status', 'timestamp', 'transaction_id', 'transaction_type']; "
        "Unexpected columns: ['another_wrong', 'wrong_column']")
    # Failed files are tried again, finished ones are not.
    write(landing, "wrong.parquet", [landing_row(transaction_id="late")])
    row = run(place, "r2")
    assert (row.files_checked, row.files_skipped, row.files_ingested) == (3, 1, 1)
    assert row.records_loaded == 1


def test_second_run_picks_up_nothing(place):
    write(place[0], "a.parquet", CLEAN_ROWS)
    run(place, "r1")
    row = run(place, "r2")
    assert (row.files_checked, row.files_skipped, row.files_processed) == (1, 1, 0)


def test_changed_file_is_read_again(place):
    write(place[0], "a.parquet", CLEAN_ROWS[:2], mtime=1_000_000)
    run(place, "r1")
    write(place[0], "a.parquet", CLEAN_ROWS, mtime=2_000_000)
    assert loaded(run(place, "r2")) == (3, 0, 2)
    # New time, same content: the hash tells.
    os.utime(place[0] / "a.parquet", (3_000_000, 3_000_000))
    assert run(place, "r3").files_skipped == 1


def test_watermark_mode_misses_late_files(place):
    landing, house = place
    write(landing, "a.parquet", CLEAN_ROWS[:2], mtime=2_000_000)
    run(place, "r1", mode="watermark")
    write(landing, "old.parquet", CLEAN_ROWS[2:3], mtime=1_000_000)
    write(landing, "new.parquet", CLEAN_ROWS[3:], mtime=3_000_000)
    row = run(place, "r2", mode="watermark")
    assert (row.files_checked, row.files_skipped, row.records_loaded) == (3, 2, 2)
    assert run(place, "r3", mode="hash").records_loaded == 1
    # The last success was the old file, and the watermark follows it down.
    meta = house.published("manifest_metadata", schemas.MANIFEST_METADATA)
    assert M.read_watermark(meta, str(landing)) == 1_000_000


def test_missing_directory_is_an_empty_run(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    row = run_ingest(house, str(tmp_path / "none"), "r1", AT).first()
    assert (row.status, row.files_checked, row.records_loaded) == ("completed", 0, 0)
    assert house.transactions().count() == 0
    assert read_transactions(spark, str(tmp_path / "none")).count() == 0


def test_listing_ignores_other_files(spark, place):
    landing, _ = place
    write(landing, "a.parquet", CLEAN_ROWS, mtime=1_700_000_000)
    (landing / ".hidden.parquet").write_bytes(b"x")
    (landing / "b.parquet.tmp").write_bytes(b"x")
    (landing / "c.partial").write_bytes(b"x")
    (landing / "sub").mkdir()
    write(landing / "sub", "d.parquet", CLEAN_ROWS)
    files = landing_files(spark, str(landing))
    assert rows_of(files, "file_path", "file_mtime") == [("a.parquet", 1_700_000_000.0)]
    import hashlib

    digest = hashlib.sha256((landing / "a.parquet").read_bytes()).hexdigest()
    assert hash_files(files).first().file_hash == digest
    assert landing_files(spark, str(landing), newer_than=1_700_000_000.0).count() == 0
    assert landing_files(spark, str(landing), newer_than=1_699_999_999.0).count() == 1


def test_accepted_physical_types(spark, place):
    landing, _ = place
    for n, (amount, instant_type) in enumerate([
        (pa.float64(), pa.timestamp("ns", "UTC")), (pa.int64(), pa.timestamp("ms")),
        (pa.int32(), pa.timestamp("us", "America/New_York")), (pa.float32(), pa.timestamp("ns")),
    ]):
        kinds = {"amount": amount, "timestamp": instant_type}
        schema = pa.schema([(f.name, kinds.get(f.name, f.type)) for f in ARROW])
        # Arrow keeps the wall time of naive values and the instant of aware ones.
        when = instant("2026-01-15 10:30")
        if instant_type.tz is None:
            when = when.replace(tzinfo=None)
        write(landing, f"f{n}.parquet", [landing_row(amount=42, timestamp=when)], schema)
    audit = schema_errors(landing_files(spark, str(landing)))
    assert rows_of(audit.where("error IS NOT NULL")) == []
    rows = read_audited(spark, audit)
    assert rows.count() == 4
    assert rows.select(*schemas.LANDING.names).distinct().count() == 1
    assert rows.first().amount == 42.0
    assert rows.first().timestamp == dt.datetime(2026, 1, 15, 10, 30)


def test_rejected_types_and_extra_columns(spark, place):
    landing, _ = place
    text_amount = pa.schema([(f.name, pa.string() if f.name == "amount" else f.type)
                             for f in ARROW])
    write(landing, "text.parquet", [landing_row(amount="42")], text_amount)
    extra = pa.schema([*ARROW, ("note", pa.string())])
    write(landing, "extra.parquet", [(*landing_row(), "n")], extra)
    audit = schema_errors(landing_files(spark, str(landing)))
    assert rows_of(audit, "file_path", "error") == [
        ("extra.parquet", "Unexpected columns: ['note']"),
        ("text.parquet", "Column 'amount' has type string, expected double")]


def test_date_range_prunes_folders_and_row_groups(place):
    landing, house = place
    rows = [landing_row(transaction_id=f"t{n}", timestamp=f"2026-0{1 + n % 3}-15 10:00")
            for n in range(9)]
    write(landing, "a.parquet", rows)
    run(place, "r1")
    part = house.transactions("2026-02-01", "2026-02-28")
    assert part.count() == 3
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(transaction_month" in plan
    assert "GreaterThanOrEqual(transaction_date,2026-02-01)" in plan


def test_repeated_run_leaves_the_same_tables(place):
    landing, house = place
    write(landing, "a.parquet", [*CLEAN_ROWS, landing_row(transaction_id="bad", amount=0.0)])
    run(place, "r1")
    before = rows_of(house.transactions()), rows_of(house.quarantine())
    row = run(place, "r1", full_refresh=True)
    assert (rows_of(house.transactions()), rows_of(house.quarantine())) == before
    assert loaded(row) == (5, 1, 0)


def test_run_leaves_no_scratch_tables(spark, place):
    from pathlib import Path

    from ledgerloom import workspace

    write(place[0], "a.parquet", CLEAN_ROWS)
    before = set(Path(workspace(spark)).iterdir()) if Path(workspace(spark)).exists() else set()
    run(place, "r1")
    assert set(Path(workspace(spark)).iterdir()) == before


def test_failed_run_is_recorded(place, monkeypatch):
    landing, house = place
    write(landing, "a.parquet", CLEAN_ROWS)

    def broken(*_):
        raise RuntimeError("lost")

    monkeypatch.setattr("ledgerloom.plans.ingest.write_batch", broken)
    with pytest.raises(RuntimeError):
        run_ingest(house, str(landing), "r1", AT)
    from ledgerloom.operators.runs import latest_events

    runs = latest_events(house.runs("ingestion_runs", schemas.INGESTION_RUNS))
    assert rows_of(runs, "run_id", "status") == [("r1", "failed")]
    manifest = house.published("file_manifest", schemas.FILE_MANIFEST)
    assert rows_of(manifest, "status") == [("pending",)]
    monkeypatch.undo()
    assert loaded(run(place, "r2")) == (5, 0, 0)


def test_manifest_steps(spark):
    at = instant("2026-01-01")
    files = spark.createDataFrame(
        [("a", "p/a", 1, 10.0, "h1"), ("b", "p/b", 1, 20.0, "h2")],
        "file_path string, path string, file_size_bytes long, file_mtime double, file_hash string")
    none = spark.createDataFrame([], schemas.FILE_MANIFEST)
    assert M.pending_files(files, none).count() == 2
    errors = spark.createDataFrame([("b", "boom"), ("a", None)], "file_path string, error string")
    done = M.update_manifest(none, M.manifest_entries(files, "r1", at, errors))
    assert rows_of(M.pending_files(files, done), "file_path") == [("b",)]
    assert rows_of(M.pending_files(files, done, watermark=20.0, mode="watermark")) == []
    assert M.pending_files(files, done, full_refresh=True).count() == 2
    assert rows_of(M.changed_files(files, done), "file_path") == [("b",)]
    again = M.update_manifest(done, M.manifest_entries(files.where("file_path = 'b'"), "r2", at))
    assert rows_of(again, "file_path", "status", "error_message") == [
        ("a", "success", None), ("b", "pending", None)]
    reset = M.reset_manifest(done, "r3", at)
    assert rows_of(reset, "status", "run_id", "error_message") == [("pending", "r3", None)] * 2
    meta = spark.createDataFrame([], schemas.MANIFEST_METADATA)
    meta = M.advance_watermark(meta, done, "dir", at)
    assert M.read_watermark(meta, "dir") == 10.0
    unchanged = M.advance_watermark(meta, done.where(F.col("status") == "failed"), "dir", at)
    assert rows_of(unchanged) == rows_of(meta)
    assert M.read_watermark(M.drop_watermark(meta, "dir"), "dir") is None
    with pytest.raises(ValueError, match="unknown mode"):
        M.pending_files(files, done, mode="x")
