"""The index of known ids: what it finds, what it reads, and runs that broke off."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import CLEAN, instant, landing_row, rows_of
from ledgerloom import schemas
from ledgerloom.plans.ingest import Warehouse, run_ingest
from ledgerloom.sources import key_index
from ledgerloom.sources.key_index import KeyIndex

AT = instant("2026-02-01")


def ids(spark, first, last):
    return spark.range(first, last).select(F.concat(F.lit("id-"), "id").alias("transaction_id"))


@pytest.fixture
def index(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "ids"))
    index.add(ids(spark, 0, 5000), "one")
    index.add(ids(spark, 4000, 9000), "two/2")
    return index


def test_known_keys_and_their_runs(spark, index):
    batch = ids(spark, 3999, 4001).unionAll(ids(spark, 8999, 9100)).unionAll(
        spark.createDataFrame([(None,)], "transaction_id string"))
    assert rows_of(index.known(batch)) == [
        ("id-3999", "one"), ("id-4000", "one"), ("id-4000", "two/2"), ("id-8999", "two/2")]
    index.add(ids(spark, 0, 10), "one")
    assert rows_of(index.known(batch)) == [("id-4000", "two/2"), ("id-8999", "two/2")]
    assert index.known(batch.limit(0)).count() == 0


def test_few_new_keys_pass_the_filters(spark, index):
    assert index.suspects(ids(spark, 20_000, 60_000)).count() < 400
    assert index.suspects(ids(spark, 0, 9000)).count() == 9000


def test_history_is_not_shuffled_and_few_buckets_are_read(spark, index):
    suspects = index.suspects(ids(spark, 10, 12))
    buckets = [r.bucket for r in suspects.select("bucket").distinct().collect()]
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        with key_index._joined_by_bucket(spark):
            found = index.lookup(suspects, buckets)
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert found.count() == 2
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    history, batch = plan.split("FileScan")[1:]
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 1
    # The one exchange lies on the side of the batch.
    assert plan.index("Exchange") > plan.index("SelectedBucketsCount")
    assert "SelectedBucketsCount: 2 out of 16" in history or "SelectedBucketsCount: 1 out of 16" in history
    assert "key" not in batch


def test_many_parts_become_one(spark, index, monkeypatch):
    monkeypatch.setattr(key_index, "MERGED_AT", 2)
    index.add(ids(spark, 9000, 9010), "three")
    assert sorted(index._parts(index._shape())) == ["merged", "three"]
    assert rows_of(index.known(ids(spark, 8999, 9001))) == [("id-8999", "merged"), ("id-9000", "three")]
    assert index.suspects(ids(spark, 0, 9010)).count() == 9010


def write(spark, folder, rows):
    spark.createDataFrame([landing_row(transaction_id=i) for i in rows], schemas.LANDING).coalesce(1).write.mode(
        "append").parquet(str(folder))


def test_a_run_that_broke_off_after_loading_is_not_loaded_again(spark, tmp_path, monkeypatch):
    house = Warehouse(spark, str(tmp_path / "house"))
    write(spark, tmp_path / "landing", ["a", "b"])

    def broken(*_):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(KeyIndex, "add", broken)
        with pytest.raises(RuntimeError):
            run_ingest(house, str(tmp_path / "landing"), "r1", AT)
    assert house.transactions().count() == 2
    row = run_ingest(house, str(tmp_path / "landing"), "r2", AT).first()
    assert (row.records_loaded, row.duplicates_skipped) == (0, 2)
    assert house.transactions().count() == 2
    assert house.known_ids().unfinished() == []


def test_an_older_warehouse_gets_its_index_from_its_rows(spark, tmp_path):
    house = Warehouse(spark, str(tmp_path / "house"))
    rows = [(*c[:1], instant("2026-01-01"), *c[2:], instant("2026-01-01").date(), "f", AT, "old") for c in CLEAN]
    house.append_transactions(spark.createDataFrame(rows, schemas.TRANSACTIONS))
    write(spark, tmp_path / "landing", [CLEAN[0][0], "new"])
    row = run_ingest(house, str(tmp_path / "landing"), "r1", AT).first()
    assert (row.records_loaded, row.duplicates_skipped) == (1, 1)
