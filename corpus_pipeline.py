"""The corpus pipeline: score, deduplicate, decontaminate, mix and pack documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm import decontam, minhash, mixing, packing, quality
from ledgerloom.llm.queries import SOURCE_WEIGHTS
from ledgerloom.llm.tables import KEY, join_small, table, with_key
from ledgerloom.session import bound_batches, scratch, stage, workspace

#: What stages read; any other column passes through under a name of its own.
_READ = ("doc_id", "text", "source")


def passing(stage_of: Callable) -> Callable:
    """Let the other columns pass a stage whatever they are called."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        names = [c if c in _READ else f"_passing{i}" for i, c in enumerate(docs.columns)]
        return stage_of(spark, docs.toDF(*names), sf_dir).toDF(*docs.columns)

    run.__name__, run.__doc__ = stage_of.__name__, stage_of.__doc__
    return run


@passing
def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the classifier takes for good."""
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where("score >= 0.7").drop("score")


@passing
def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group: least id, nulls last, then least key.

    Of rows that repeat its id and text, the one whose other columns hash least stays.
    Texts without words belong to no group and all stay.
    """
    groups = stage(
        minhash.groups(docs, n=5, percent=80).where("root is not null").select("root", "id", *KEY),
        "groups",
    )
    first = F.min(F.struct(F.col("id").isNull().alias("no_id"), "id", *KEY)).alias("_first")
    shared = stage(
        groups.groupBy("root").agg(first, F.count("*").alias("_n")).where("_n > 1")
        .select("root", *(F.col(f"_first.{k}").alias(f"_of{k}") for k in KEY)),
        "shared",
    )
    is_first = reduce(and_, (F.col(k) == F.col(f"_of{k}") for k in KEY))
    copies = stage(
        join_small(groups, shared, "root", "inner").groupBy(*KEY)
        .agg(F.max(is_first).alias("first"), F.count("*").alias("_n")),
        "copies",
    )
    gone = stage(copies.where("not first").select(*KEY), "gone")
    left = join_small(with_key(docs, "doc_id", "text"), gone, KEY, "left_anti")
    repeated = stage(copies.where("first and _n > 1").select(*KEY), "repeated")
    if not repeated.take(1):
        return left.select(*docs.columns)
    others = [
        F.col(f.name) for f in docs.schema
        if f.name not in ("doc_id", "text") and not isinstance(f.dataType, (T.MapType, T.VariantType))
    ]
    one = F.min_by(F.struct(*docs.columns), F.xxhash64(F.lit(0), *others)).alias("_row")
    once = join_small(left, repeated, KEY, "left_semi").groupBy(*KEY).agg(one).select("_row.*")
    return join_small(left, repeated, KEY, "left_anti").select(*docs.columns).unionByName(once)


@passing
def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of a benchmark item."""
    found = decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), n=10)
    return found.where("not contaminated").select(*docs.columns)


@passing
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources by weight: each document as often as the mix takes it."""
    weights = mixing.ranked_weights(docs, "source", SOURCE_WEIGHTS)
    return mixing.repeat_rows(mixing.mix(docs, weights, max_epochs=3.0), docs.columns)


def pack_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed token rows."""
    bound_batches(spark)
    return packing.pack(docs, length=2048)


STAGES = [
    ("quality classifier", keep_good),
    ("MinHash near-dedup", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("mixing sources", mix_sources),
    ("token packing", pack_tokens),
]

#: Training, signatures and tokenisers are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = f"{workspace(spark)}/{name.replace(' ', '-')}-{uuid.uuid4().hex}"
        # What a stage staged for itself goes when its result is written.
        with scratch(spark):
            function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
