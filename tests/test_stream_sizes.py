"""What a streamed ingestion keeps on disk."""

import time

import pytest

from ledgerloom import configure, schemas
from ledgerloom.plans import testdata as td
from ledgerloom.plans.registry import QUERIES

from conftest import rows_of

SF_DIR = "/root/testdata/sf0.001"


def shuffle_files(spark):
    jvm = spark.sparkContext._jvm
    files = jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()
    return {name for name in (files.apply(i).getName() for i in range(files.size())) if name.startswith("shuffle_")}


@pytest.mark.parametrize("name", ["stream_ingest", "ingest_pipeline"])
def test_few_shuffles_outlive_their_action(spark, name):
    next_id = spark.sparkContext._jsc.sc().newShuffleId
    before, first = shuffle_files(spark), next_id()
    loaded = QUERIES[name](spark, SF_DIR)
    made = next_id() - first
    for _ in range(50):  # files go a moment after the action
        left = {file.split("_")[1] for file in shuffle_files(spark) - before}
        if not left:
            break
        time.sleep(0.1)
    # A stage that adaptive execution gave up may write after its files went.
    assert made > 20 and len(left) * 5 <= made
    assert loaded.count() > 0


def test_verdicts_are_written_without_a_sort(spark):
    # Spark sorts what follows the row that opens the last allowed file.
    assert int(spark.conf.get("spark.sql.maxConcurrentOutputFileWriters")) > 2


def test_landed_rows_are_dealt_out_narrow_and_in_order(spark, tmp_path):
    with td.call(shared=False):
        rows = td.landing_in_order(spark, SF_DIR)
        wanted = td.landing_dirty(spark, SF_DIR).orderBy(*td.ROW_ORDER)
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [l_shipdate" in plan and "Sort [timestamp" in plan
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        rows.select(*schemas.LANDING.names).write.parquet(str(tmp_path / "rows"))
    finally:
        configure(spark)
    files = sorted((tmp_path / "rows").glob("*.parquet"))
    assert len(files) > 1
    found = [row for file in files for row in spark.read.parquet(str(file)).select(*td.ROW_ORDER).collect()]
    assert found == wanted.select(*td.ROW_ORDER).collect()
    assert rows_of(spark.read.parquet(str(tmp_path / "rows"))) == rows_of(wanted.select(*schemas.LANDING.names))


def test_lines_meet_parts_before_orders(spark):
    held = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = td._lines(spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", held)
    assert plan.index("(l_suppkey") < plan.index("(l_orderkey") < plan.index("(l_partkey")
