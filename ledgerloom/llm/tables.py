"""Reading, row keys and size-checked joins shared by the operators."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A side is broadcast only while the table it is read from is no larger than this.
BROADCAST_BYTES = 8 << 20

KEY = ["_key1", "_key2"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_key(*columns: str) -> list[Column]:
    """A 128-bit key of a row's content; rows that agree in it are interchangeable.

    A null hashes like an absent value, so whether each column is null is hashed too.
    """
    nulls = [F.col(c).isNull() for c in columns]
    values = [F.col(c) for c in columns]
    return [
        F.xxhash64(F.lit(seed), *nulls, *values).alias(name)
        for seed, name in zip((17, 7919), KEY, strict=True)
    ]


def with_key(df: DataFrame, *columns: str) -> DataFrame:
    return df.select("*", *row_key(*columns))


def known_bytes(df: DataFrame) -> int:
    """Size the planner has for ``df``; that of the files for a table just read."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def join_small(df: DataFrame, staged: DataFrame, on, how: str = "left") -> DataFrame:
    """Join a written table, broadcasting it only if its files are small.

    Beyond the bound the planner shuffles both sides and splits skewed partitions.
    """
    side = F.broadcast(staged) if known_bytes(staged) <= BROADCAST_BYTES else staged
    return df.join(side, on, how)


def aside(
    df: DataFrame, results: Sequence[str], inner: Sequence[str] = (), used: Sequence[str] = ()
) -> tuple[DataFrame, list[Column]]:
    """Rename input columns that clash with an operator's own, and how to name them back.

    ``used`` columns stay as they are.  An input column with the name of a result is
    not named back: the result takes its place.
    """
    own = {n.lower() for n in (*results, *inner)}
    taken = {n.lower() for n in results}
    names = [
        c if c in used or c.lower() not in own else f"_aside{i}" for i, c in enumerate(df.columns)
    ]
    back = [
        F.col(n).alias(c) for n, c in zip(names, df.columns, strict=True)
        if c in used or c.lower() not in taken
    ]
    return df.toDF(*names), back


def given_back(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches; what Arrow freed behind each goes back, as a worker outlives its tasks."""
    for batch in batches:
        yield batch
        del batch
        pa.default_memory_pool().release_unused()


def runs_of(batches: Iterator[pa.RecordBatch], keys: Sequence[str]) -> Iterator[pa.Table]:
    """The rows of each key, one table at a time, from batches sorted by integer keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(batch.num_rows, bool)
        for column in columns:
            change[1:] |= column[1:] != column[:-1]
        first = tuple(c[0] for c in columns)
        change[0] = last is not None and first != last
        start = 0
        for at in np.flatnonzero(change):
            if at > start:
                held.append(batch.slice(start, at - start))
            yield pa.Table.from_batches(held)
            held, start = [], at
        held.append(batch.slice(start))
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)
