"""Plans end to end: load, build, check, catalogue and stream."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from conftest import instant, rows_of, staged_frame
from ledgerloom import schemas
from ledgerloom.operators import catalog as C
from ledgerloom.operators import marts as A
from ledgerloom.operators import runs as R
from ledgerloom.plans import warehouse as W
from ledgerloom.plans.ingest import Warehouse, run_ingest
from ledgerloom.sources import tables as S
from ledgerloom.streaming import ingest as Stream
from test_ingest import CLEAN_ROWS, write

AT = instant("2026-02-01")


@pytest.fixture(scope="module")
def built(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("built")
    landing = root / "landing"
    landing.mkdir()
    write(landing, "a.parquet", CLEAN_ROWS)
    house = Warehouse(spark, str(root / "house"))
    run_ingest(house, str(landing), "ingest-1", AT)
    W.build_models(house, "models-1")
    W.build_dimension(house, dt.date(2026, 1, 1), "dim-1")
    W.build_fact(house)
    return house


def test_build_results(built):
    tables = W.model_tables(built)
    assert tables["fct_transactions"].where("account_sk = -1").count() == 0
    assert tables["daily_spend_by_category"].count() == 3
    assert rows_of(built.runs("dim_build_runs", schemas.DIM_BUILD_RUNS),
                   "accounts_processed", "new_versions", "unchanged") == [(3, 3, 0)]


def test_rebuild_is_idempotent(built):
    before = {n: rows_of(t) for n, t in W.model_tables(built).items()}
    W.build_models(built, "models-2")
    W.build_dimension(built, dt.date(2026, 1, 2), "dim-2")
    W.build_fact(built)
    assert {n: rows_of(t) for n, t in W.model_tables(built).items()} == before


def test_checks_are_recorded(built):
    row = W.check_warehouse(built, run_id="check-1", as_of=AT).first()
    assert (row.status, row.total_checks, row.checks_passed) == ("passed", 13, 13)
    results = built.runs("check_results", schemas.CHECK_RESULTS)
    assert results.where("run_id = 'check-1'").count() == 13
    runs = R.latest_events(built.runs("check_runs", schemas.CHECK_RUNS))
    assert R.latest_check(runs).first().checks_passed == 13
    assert R.latest_check_results(results, runs).count() == 13


def test_failed_build_keeps_the_dimension(built, monkeypatch):
    before = rows_of(built.published("dim_accounts", schemas.DIM_ACCOUNTS))
    monkeypatch.setattr(
        W, "account_profiles",
        lambda _: built.spark.range(1).select(F.raise_error(F.lit("no staging"))))
    with pytest.raises(Exception, match="no staging"):
        W.build_dimension(built, dt.date(2026, 1, 3), "dim-3")
    assert rows_of(built.published("dim_accounts", schemas.DIM_ACCOUNTS)) == before


def test_catalog(built):
    spark = built.spark
    models = spark.createDataFrame(
        [("fct_transactions", "facts", "stg_transactions, dim_accounts", "")], C.MODEL_METADATA)
    keys = spark.createDataFrame([("dim_accounts", "account_sk", "A version.", True)], C.COLUMN_METADATA)
    tables, columns = W.build_catalog(built, AT, columns_metadata=keys, models=models)
    got = {r.table_name: r for r in tables.collect()}
    assert got["transactions"].zone == "raw"
    assert got["transactions"].row_count == 5
    assert got["stg_transactions"].table_type == "VIEW"
    assert got["stg_transactions"].row_count is None
    assert got["fct_transactions"].depends_on == "stg_transactions, dim_accounts"
    key = columns.where("table_name = 'dim_accounts' AND column_name = 'account_sk'").first()
    assert key.is_pk
    assert key.sample_values == '["1", "2", "3"]'
    views = columns.where("table_name = 'stg_transactions'")
    assert views.count() == 13
    assert views.where("sample_values IS NOT NULL").count() == 0
    again, _ = W.build_catalog(built, AT, columns_metadata=keys, models=models)
    assert rows_of(again) == rows_of(tables)


def test_unbuilt_tables_are_errors(spark, tmp_path):
    row = W.check_warehouse(Warehouse(spark, str(tmp_path)), as_of=AT).first()
    assert row.status == "warn"
    assert row.checks_errored == 10


@pytest.mark.parametrize(("name", "zone"), [
    ("stg_x_runs", "staging"), ("dim_build_runs", "dimension"), ("fct_x", "fact"),
    ("transactions", "raw"), ("quarantine", "raw"), ("check_results", "metadata"),
    ("catalog_tables", "metadata"), ("file_manifest", "mart"), ("daily", "mart")])
def test_zones(spark, name, zone):
    assert spark.range(1).select(C.infer_zone(F.lit(name))).first()[0] == zone


def test_overlay_prefers_metadata(spark):
    profile = C.table_profile({"stg_a": spark.range(3), "plain": spark.range(2)}, ["plain"])
    meta = spark.createDataFrame([("stg_a", "", "", "me"), ("plain", "raw", "text", "")],
                                 C.TABLE_METADATA)
    models = spark.createDataFrame([("stg_a", "m", "x", "from model")], C.MODEL_METADATA)
    got = {r.table_name: r for r in C.overlay(profile, meta, models).collect()}
    assert (got["stg_a"].zone, got["stg_a"].description, got["stg_a"].owner) == (
        "staging", "from model", "me")
    assert (got["plain"].zone, got["plain"].description, got["plain"].owner) == ("raw", "text", "")
    assert (got["stg_a"].row_count, got["plain"].row_count) == (3, None)


def test_samples_are_the_smallest_distinct(spark):
    df = spark.createDataFrame(
        [("b", 2.0, None), ("a", 1.5, None), ("b", 2.0, None), ("d", 1e7, None), ("c", 3.0, None)],
        "s string, x double, n int")
    got = {r.column_name: r for r in C.column_profile({"t": df}, keys={("t", "s")}).collect()}
    assert got["s"].sample_values == '["a", "b", "c"]'
    assert got["x"].sample_values == '["1.5", "2.0", "3.0"]'
    assert got["n"].sample_values is None
    assert (got["s"].is_pk, got["s"].data_type, got["x"].ordinal_position) == (True, "VARCHAR", 2)


def test_samples_in_one_scan(spark):
    df = spark.createDataFrame(
        [([2.0, None], True, float("nan"), b"b", "é"), ([2.0, 1.0], False, -0.0, b"", "z"), ([], None, 0.0, None, ""),
         ([2.0, None], True, 5e-5, b"a", None), (None, None, None, None, "\n")],
        "a array<double>, b boolean, x float, raw binary, s string").repartition(3)
    got = {r.column_name: r.sample_values for r in C.column_profile({"t": df}).collect()}
    assert got["a"] == '["[]", "[2.0, NULL]", "[2.0, 1.0]"]'
    assert got["b"] == '["false", "true"]'
    assert got["x"] == '["0.0", "5e-05", "nan"]'
    assert got["s"] == '["", "\\n", "z"]'
    assert got["raw"] == '["", "a", "b"]'
    plan = C._samples(df, 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("RDD") == 1


def test_replaced_tables_and_views(spark):
    S.replace_table(spark.range(3).toDF("x"), "kept", ["x"])
    S.replace_table(spark.range(2).toDF("x"), "kept")
    S.replace_view(spark.range(5).toDF("y"), "seen")
    assert S.read_table(spark, "kept").count() == 2
    assert S.read_table(spark, "seen").count() == 5


def test_publish_reads_what_it_replaces(spark, tmp_path):
    root = str(tmp_path / "t")
    first = S.publish(spark.range(3).toDF("x"), root)
    S.publish(first.withColumn("x", F.col("x") + 10), root)
    assert rows_of(S.latest(spark, root, first.schema)) == [(10,), (11,), (12,)]
    (tmp_path / "t" / "_log" / f"{2:010d}").unlink()
    assert rows_of(S.latest(spark, root, first.schema)) == [(0,), (1,), (2,)]


@pytest.mark.parametrize("fmt", ["parquet", "csv"])
def test_export_round_trip(spark, tmp_path, fmt):
    df = spark.createDataFrame(CLEAN_ROWS, schemas.LANDING)
    S.export(df, str(tmp_path / "out"), fmt)
    back = S.read_export(spark, str(tmp_path / "out"), fmt, schemas.LANDING)
    assert rows_of(back) == rows_of(df)
    with pytest.raises(ValueError, match="unknown export format"):
        S.export(df, str(tmp_path / "x"), "xml")


def test_run_rows(spark):
    shape = schemas.INGESTION_RUNS
    runs = R.run_started(spark, shape, "a", instant("2026-01-01")).unionByName(
        R.run_started(spark, shape, "b", instant("2026-01-02"))).unionByName(
        R.audit_row(spark, shape, run_id="a", started_at=instant("2026-01-01"),
                    completed_at=instant("2026-01-01"), status="completed", records_loaded=3))
    state = R.latest_events(runs)
    assert rows_of(state, "run_id", "status") == [("a", "completed"), ("b", "running")]
    assert R.latest_ingestion(state).first().status == "running"
    with pytest.raises(ValueError, match="not in the audit table"):
        R.audit_row(spark, shape, nonsense=1)


def test_stream_equals_batch_and_stops(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    write(landing, "a.parquet", CLEAN_ROWS[:3])
    write(landing, "b.parquet", CLEAN_ROWS)
    house = Warehouse(spark, str(tmp_path / "house"))

    def load():
        run = Stream.ingest_stream(spark, str(landing), house, str(tmp_path / "progress"), 1)
        run.awaitTermination()

    load()
    assert house.transactions().count() == 5
    first = rows_of(house.transactions())
    load()
    assert rows_of(house.transactions()) == first
    write(landing, "c.parquet", [(*("new",), *CLEAN_ROWS[0][1:])])
    load()
    assert house.transactions().count() == 6


def test_daily_stream_equals_batch(spark, tmp_path):
    stg = staged_frame(spark)
    folder = tmp_path / "staged"
    stg.repartition(4).write.parquet(str(folder))
    stream = spark.readStream.schema(stg.schema).option("maxFilesPerTrigger", 1).parquet(
        str(folder))
    out = str(tmp_path / "mart")
    Stream.write_daily_spend(stream, out, str(tmp_path / "progress")).awaitTermination()
    assert rows_of(Stream.read_daily_spend(spark, out)) == rows_of(A.daily_spend(stg))
