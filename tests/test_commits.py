"""Tables with two writers, old versions, and a dimension that is only added to."""

from __future__ import annotations

import datetime as dt
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import functions as F

from conftest import rows_of, staged_frame
from ledgerloom import schemas
from ledgerloom.operators.marts import daily_spend
from ledgerloom.plans import warehouse as W
from ledgerloom.plans.ingest import Warehouse
from ledgerloom.sources import tables as S
from ledgerloom.sources.files import write_once
from ledgerloom.streaming.ingest import read_daily_spend, write_daily_spend


def test_a_name_is_taken_once(spark, tmp_path):
    place = str(tmp_path / "log" / "1")
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda i: write_once(spark, place, str(i)), range(16)))
    assert won.count(True) == 1
    assert Path(place).read_text() == str(won.index(True))
    assert [p.name for p in Path(place).parent.iterdir() if not p.name.endswith(".crc")] == ["1"]


def test_two_publishers_lose_neither_version(spark, tmp_path):
    root = str(tmp_path / "t")
    with ThreadPoolExecutor(4) as pool:
        list(pool.map(lambda i: S.publish(spark.range(i, i + 1).toDF("x"), root), range(4)))
    held = [S.read_version(spark, root, n) for n in (1, 2, 3, 4)]
    shape = spark.range(1).toDF("x").schema
    seen = [S.read_parts(spark, root, v.folders(), shape).first().x for v in held]
    assert sorted(seen) == [0, 1, 2, 3]
    assert S.latest(spark, root, shape).first().x == seen[-1]


def test_two_updates_lose_neither_change(spark, tmp_path):
    root, shape = str(tmp_path / "t"), spark.range(1).toDF("x").schema

    def add(i):
        S.update(spark, root, shape, lambda held: held.unionAll(spark.range(i, i + 1)))

    with ThreadPoolExecutor(4) as pool:
        list(pool.map(add, range(4)))
    assert rows_of(S.latest(spark, root, shape)) == [(0,), (1,), (2,), (3,)]
    # Rows written for a commit that was lost are gone.
    assert len(list(Path(root, "data").iterdir())) == 4


def test_old_versions_go_with_their_rows(spark, tmp_path):
    root = str(tmp_path / "t")
    for i in range(5):
        S.publish(spark.range(i + 1).toDF("x"), root, keep=2)
    idle = S.write_part(spark.range(9).toDF("x"), root)
    S.publish(spark.range(6).toDF("x"), root, keep=2)
    assert [S.read_version(spark, root, n).number for n in (5, 6)] == [5, 6]
    assert len(list(Path(root, "_log").glob("[0-9]*"))) == 2
    # Two versions, and what a writer has not committed yet.
    folders = {p.name for p in Path(root, "data").iterdir()}
    assert len(folders) == 3
    assert idle.split("/")[1] in folders
    assert S.latest(spark, root, spark.range(1).toDF("x").schema).count() == 6


def test_states_of_a_stream_become_a_base(spark, tmp_path):
    rows = staged_frame(spark)
    ids = [r.transaction_id for r in rows.select("transaction_id").orderBy("transaction_id").collect()]
    files, out = tmp_path / "files", tmp_path / "mart"
    for i in ids:
        rows.where(F.col("transaction_id") == i).coalesce(1).write.mode("append").parquet(str(files))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(files))
    write_daily_spend(stream, str(out), str(tmp_path / "progress"), every=3).awaitTermination()
    assert rows_of(read_daily_spend(spark, str(out))) == rows_of(daily_spend(rows))
    through = S.head(spark, str(out / "_base")).notes["through"]
    assert through == 8
    batches = sorted(int(p.name.split("=")[1]) for p in out.glob("batch_id=*"))
    assert batches[0] == 6  # what the base before held is gone
    # A batch that is done again after the base holds it changes nothing.
    wrong = spark.read.parquet(str(out / "batch_id=8")).withColumn("total_amount", F.lit(-1.0))
    wrong.write.mode("overwrite").parquet(str(out / "batch_id=2"))
    found = read_daily_spend(spark, str(out))
    assert rows_of(found) == rows_of(daily_spend(rows))
    scanned = found._jdf.queryExecution().executedPlan().toString()
    assert "batch_id#" in scanned and f"> {through}" in scanned


def _files(root: Path) -> dict[str, int]:
    return {str(p): p.stat().st_mtime_ns for p in root.rglob("*.parquet")}


def profiles(spark, changed):
    rows = [(f"ACC-{i:05d}", "GBP", "Bread", 1 + (i in changed), 5.0, dt.date(2026, 1, 1),
             dt.date(2026, 1, 2), f"hash-{i}-{i in changed}") for i in range(8)]
    names = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in schemas.DIM_ACCOUNTS.fields[1:9])
    return spark.createDataFrame(rows, names)


def build(house, spark, day, changed):
    return W._commit_build(house, profiles(spark, changed), dt.date(2026, 1, day), f"run-{day}", False)


def test_a_build_writes_no_closed_row_again(spark, tmp_path, monkeypatch):
    house = Warehouse(spark, str(tmp_path))
    root = tmp_path / "dim_accounts"
    build(house, spark, 1, ())
    build(house, spark, 2, (0, 1))
    second = S.head(spark, str(root))
    before = _files(root)
    build(house, spark, 3, ())
    third = S.head(spark, str(root))
    assert third.folders("closed")[:1] == second.folders("closed")
    written = [p for p in _files(root) if p not in before]
    new = spark.read.schema(schemas.DIM_ACCOUNTS).parquet(*written)
    # Two versions ended by this build, and the eight open ones.
    assert new.where("not is_current").count() == 2
    assert new.count() == 10
    dim = house.published("dim_accounts", schemas.DIM_ACCOUNTS)
    assert dim.count() == 12
    assert rows_of(dim.groupBy("account_id").agg(F.count_if("is_current").alias("n")).select("n").distinct()) == [(1,)]
    assert dim.agg(F.count_distinct("account_sk")).first()[0] == 12
    # Nothing changed: no closed part, the same rows.
    build(house, spark, 4, ())
    assert S.head(spark, str(root)).folders("closed") == third.folders("closed")
    monkeypatch.setattr(W, "CLOSED_PARTS", 2)
    for day in range(5, 9):
        build(house, spark, day, (day,) if day % 2 else ())
        assert len(S.head(spark, str(root)).folders("closed")) <= 2
    assert house.published("dim_accounts", schemas.DIM_ACCOUNTS).where("not is_current").count() == 8


def test_two_builds_at_once_both_count(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path))
    with ThreadPoolExecutor(2) as pool:
        list(pool.map(lambda day: build(house, spark, day, (day,)), (1, 2)))
    dim = house.published("dim_accounts", schemas.DIM_ACCOUNTS)
    assert dim.where("is_current").count() == 8
    assert dim.agg(F.count_distinct("account_sk")).first()[0] == dim.count() == 10
    assert staged_frame(spark).count() == 9
