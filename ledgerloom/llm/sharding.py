"""Shuffle a corpus into shards in two passes, each within bounded memory."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from ledgerloom.llm.tables import KEY, aside, join_small, with_key
from ledgerloom.session import stage

_RESULTS = ["shard", "slot", "grown_shard"]
_INNER = ["bucket", "part", "place", "_best", "_n", "_parts", "_base", *KEY]
#: Bytes a row takes besides its text.
ROW_BYTES = 16


def _rendezvous(id_col: str, shards: int, seed: int):
    """The shard whose seeded hash with the id is largest, and the same with one more shard.

    A new shard wins only the ids for which it hashes highest, so growing moves
    rows into the new shard alone.
    """
    def score(shard):
        return F.xxhash64(F.lit(seed), shard, F.col(id_col))

    best = F.array_max(F.transform(
        F.sequence(F.lit(0), F.lit(shards - 1)),
        lambda s: F.struct(score(s).alias("score"), s.alias("shard")),
    ))
    new = F.lit(shards)
    return best, lambda b: F.when(score(new) > b["score"], new).otherwise(b["shard"])


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    """A seeded permutation: each place swaps with a uniform one not behind it."""
    order = np.arange(n)
    draws = np.random.default_rng(seed).integers(0, np.arange(n, 0, -1)) if n else order
    for i, j in zip(range(n - 1, 0, -1), draws, strict=False):
        order[i], order[j] = order[j], order[i]
    return order


def _shuffled(seed: int):
    def shuffle(bucket: pa.Table) -> pa.Table:
        # The order rows arrive in depends on the tasks; that of their keys does not.
        bucket = bucket.combine_chunks().sort_by([(k, "ascending") for k in KEY])
        name = [int(bucket.column(c)[0].as_py()) for c in ("shard", "bucket", "part")]
        order = fisher_yates(bucket.num_rows, [seed, *name])
        place = pa.array(np.arange(bucket.num_rows), pa.int32())
        return bucket.take(pa.array(order)).append_column("place", place)

    return shuffle


def shard(
    docs: DataFrame,
    shards: int = 40,
    id_col: str = "doc_id",
    text_col: str = "text",
    bucket_bytes: int = 16 << 20,
    seed: int = 10,
) -> DataFrame:
    """Write the rows of ``docs`` to shuffled shards and return a reader of them.

    Pass one scatters the rows of each shard over buckets of about
    ``bucket_bytes`` by a seeded hash of id and text.  Pass two shuffles each
    bucket in memory (Fisher-Yates, seeded by the bucket) and writes it.  A bucket
    that copies of one row make larger than four times the bound is split further
    by row position, so no task ever holds more.

    Adds ``shard`` (decided by the id and the shard count alone), ``grown_shard``
    (with one more shard), and ``slot``, the gapless place in the shard.  Null ids
    are one id; null texts have no bytes; an empty table gives no rows.  Input columns
    with the names of results are replaced; files keep them under another name.
    """
    docs, back = aside(docs, _RESULTS, _INNER, [id_col, text_col])
    best, grown = _rendezvous(id_col, shards, seed)
    bytes_of = (F.coalesce(F.octet_length(text_col), F.lit(0)) + ROW_BYTES).cast("long")
    placed = with_key(docs, id_col, text_col).withColumn("_best", best).withColumns({
        "shard": F.col("_best.shard"), "grown_shard": grown(F.col("_best")),
    }).drop("_best")

    sizes = placed.groupBy("shard").agg(F.sum(bytes_of).alias("_n"))
    sizes = stage(sizes.select("shard", F.ceil(F.col("_n") / bucket_bytes).alias("_n")), "shards")
    bucket = F.pmod(F.xxhash64(F.lit(seed + 1), *KEY), F.col("_n")).cast("int")
    scattered = join_small(placed, sizes, "shard", "inner").withColumn("bucket", bucket)

    loads = scattered.groupBy("shard", "bucket").agg(F.sum(bytes_of).alias("_n"))
    large = stage(
        loads.where(F.col("_n") > 4 * bucket_bytes)
        .select("shard", "bucket", F.ceil(F.col("_n") / bucket_bytes).alias("_parts")),
        "large",
    )
    position = F.xxhash64(F.monotonically_increasing_id())
    part = F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(position, F.col("_parts")))
    split = join_small(scattered.drop("_n"), large, ["shard", "bucket"]).withColumn(
        "part", part.cast("int")
    ).drop("_parts")

    schema = StructType([*split.schema.fields, StructField("place", IntegerType())])
    written = stage(
        split.groupBy("shard", "bucket", "part")
        .applyInArrow(_shuffled(seed), schema)
        .sortWithinPartitions("shard", "bucket", "part", "place"),
        "shards", partition_by=["shard"],
    )
    # Counted on what was written, so places and bases always agree.
    before = Window.partitionBy("shard").orderBy("bucket", "part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    bases = stage(
        written.groupBy("shard", "bucket", "part").agg(F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n"),
        "bases",
    )
    return join_small(written, bases, ["shard", "bucket", "part"], "inner").select(
        *back, "shard", (F.col("_base") + F.col("place")).alias("slot"), "grown_shard",
    )
