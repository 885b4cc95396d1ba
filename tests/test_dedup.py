from pyspark.sql import functions as F

from conftest import rows_of
from ledgerloom.operators import dedup as D

SHAPE = "transaction_id string, amount double, source_file string, _source_row long"
IDS = ["id-1", "id-2", "id-1", "id-3", "id-2"]
AMOUNTS = [10.0, 20.0, 99.0, 30.0, 88.0]


def batch(spark):
    rows = [(i, a, "f1", n) for n, (i, a) in enumerate(zip(IDS, AMOUNTS, strict=True))]
    return spark.createDataFrame(rows, SHAPE)


def test_first_row_wins(spark):
    out = D.dedup_first(batch(spark))
    assert rows_of(out, "transaction_id", "amount") == [
        ("id-1", 10.0), ("id-2", 20.0), ("id-3", 30.0)]


def test_file_order_decides_across_files(spark):
    rows = [("x", 2.0, "b", 0), ("x", 1.0, "a", 5), ("y", 3.0, "b", 1)]
    out = D.dedup_first(spark.createDataFrame(rows, SHAPE))
    assert rows_of(out, "transaction_id", "amount") == [("x", 1.0), ("y", 3.0)]


def test_drop_existing(spark):
    known = spark.createDataFrame([("id-2",), ("id-2",), ("zz",)], "transaction_id string")
    assert rows_of(D.drop_existing(batch(spark), known), "transaction_id") == [
        ("id-1",), ("id-1",), ("id-3",)]


def test_labels_add_up(spark):
    rows = [("x", 1.0, "a", 0), ("x", 1.0, "a", 1), ("y", 1.0, "a", 2), ("x", 1.0, "b", 0),
            ("z", 1.0, "b", 1), ("z", 1.0, "b", 2), ("k", 1.0, "b", 3), ("k", 1.0, "b", 4)]
    df = spark.createDataFrame(rows, SHAPE)
    known = spark.createDataFrame([("k",)], "transaction_id string")
    labels = D.label_duplicates(df, known)
    assert rows_of(labels) == [("a", 3, 2, 1, 0), ("b", 5, 1, 2, 2)]


def test_counts_include_files_without_valid_rows(spark):
    rows = [("x", "a", True), ("x", "a", True), ("q", "a", False), ("q", "c", False)]
    df = spark.createDataFrame(rows, "transaction_id string, source_file string, _is_valid boolean")
    counts = D.ingest_counts(df)
    assert rows_of(counts) == [("a", 3, 1, 1, 1, 0, 1), ("c", 1, 0, 1, 0, 0, 0)]
    assert tuple(D.run_totals(counts).first()) == (2, 1, 2, 1)
    assert tuple(D.run_totals(counts.limit(0)).first()) == (0, 0, 0, 0)


def test_hot_id_is_cut_down_before_the_shuffle(spark):
    df = spark.range(30000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.col("id").cast("string"))
        .alias("transaction_id"),
        F.lit(1.0).alias("amount"), F.lit("f").alias("source_file"),
        F.col("id").alias("_source_row"))
    out = D.dedup_first(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.index("Final") < plan.index("Exchange") < plan.index("Partial")
    assert out.count() == 20001
    assert out.where("transaction_id = 'hot'").first()._source_row == 0
