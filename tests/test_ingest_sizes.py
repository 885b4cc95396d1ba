"""What an ingestion run moves and writes."""

from ledgerloom.operators.dedup import ingest_counts
from ledgerloom.operators.rows import VALID
from ledgerloom.plans.registry import QUERIES
from ledgerloom.session import workspace
from ledgerloom.sources.files import child_names
from ledgerloom.sources.key_index import KeyIndex

from conftest import rows_of

SF_DIR = "/root/testdata/sf0.001"


def staged(spark, table):
    return sum(name.startswith(f"{table}-") for name in child_names(spark, workspace(spark)))


def test_an_index_without_parts_is_not_searched(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "ids"))
    index.rebuild(spark.createDataFrame([], "transaction_id string, part string"))
    keys = spark.createDataFrame([("a",), ("b",)], "transaction_id string")
    before = staged(spark, "suspects")
    assert index.known(keys).count() == 0 and staged(spark, "suspects") == before
    index.add(keys.where("transaction_id = 'a'"), "run-1")
    assert rows_of(index.known(keys)) == [("a", "run-1")]


def test_bits_of_keys_do_not_travel(spark, tmp_path):
    index = KeyIndex(spark, str(tmp_path / "ids"))
    index.rebuild(spark.createDataFrame([("a", "p")], "transaction_id string, part string"))
    keys = spark.range(9).selectExpr("string(id) AS transaction_id")
    plan = index._suspects(keys, index._shape())._jdf.queryExecution().optimizedPlan().toString()
    assert " AS b0" not in plan


def test_ingestion_leaves_no_copy_of_the_landed_rows(spark):
    before = staged(spark, "landing")
    assert QUERIES["ingest_pipeline_quarantine"](spark, SF_DIR).count() > 0
    assert staged(spark, "landing") == before


def test_rows_without_a_file_count_for_none(spark):
    rows = spark.createDataFrame(
        [("a", "f", True), ("a", None, True), ("b", None, True), ("c", "f", False)],
        f"transaction_id string, source_file string, {VALID} boolean",
    )
    counts = ingest_counts(rows).where("source_file = 'f'")
    assert rows_of(counts, "rows_read", "loaded", "quarantined", "skipped") == [(2, 1, 1, 0)]
    plan = ingest_counts(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("isnotnull(source_file") >= 2
