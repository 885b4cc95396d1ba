"""Numbering and running values over a global order, without one big sorted task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.session import stage

_POSITION, _PART, _BASE, _SIZE = "_position", "_part", "_base", "_size"
# monotonically_increasing_id keeps the row number in its low 33 bits.
_ROW_BITS = 33


def _place(df: DataFrame, order: Sequence[str]) -> DataFrame:
    """Range-partition and sort ``df``, writing each row's (partition, row) position.

    The positions are written before they are used twice, so that a rerun of a
    lost task cannot see other range boundaries.
    """
    placed = df.orderBy(*order).withColumn(_POSITION, F.monotonically_increasing_id())
    return stage(placed, "ordered").withColumn(_PART, F.shiftright(_POSITION, _ROW_BITS))


def _with_base(placed: DataFrame, weight: Column) -> DataFrame:
    """Add the total weight of all earlier sort partitions.

    The offsets hold one row per sort partition, at most
    ``spark.sql.shuffle.partitions`` of them, hence the single window and the
    broadcast.
    """
    earlier = Window.orderBy(_PART).rowsBetween(Window.unboundedPreceding, -1)
    bases = (
        placed.groupBy(_PART)
        .agg(F.sum(weight).alias(_SIZE))
        .select(_PART, F.coalesce(F.sum(_SIZE).over(earlier), F.lit(0)).alias(_BASE))
    )
    return placed.join(F.broadcast(bases), _PART)


def number_rows(
    df: DataFrame, order: Sequence[str], name: str, start: Column | int = 0
) -> DataFrame:
    """Number rows ``start + 1, start + 2, ...`` in the given order, without gaps."""
    first = start if isinstance(start, Column) else F.lit(start)
    row = F.col(_POSITION).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    based = _with_base(_place(df, order), F.lit(1))
    return based.select(
        (first + F.col(_BASE) + row + 1).cast("long").alias(name), *df.columns
    )


def running_total(df: DataFrame, order: Sequence[str], weight: str, name: str) -> DataFrame:
    """Add the inclusive running total of ``weight`` in the given global order."""
    within = (
        Window.partitionBy(_PART)
        .orderBy(_POSITION)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    based = _with_base(_place(df, order), F.col(weight))
    return based.select(
        *df.columns, (F.col(_BASE) + F.sum(weight).over(within)).alias(name)
    )


def before_in_group(
    df: DataFrame,
    key: Sequence[str],
    chunk: Column,
    order: Sequence[str],
    name: str,
    rows: Column,
    chunks: Column,
    merge,
) -> DataFrame:
    """Aggregate, for every row, the earlier rows of its key.

    Each key is cut into order-preserving chunks: one window runs inside a
    chunk, one over the much shorter list of chunks, so a key that owns a third
    of all rows is spread over as many tasks as it has chunks.

    ``rows`` aggregates the rows of a chunk, ``chunks`` folds the column
    ``_chunk_value`` of whole chunks, and ``merge`` joins the two results
    (either may be NULL when nothing came earlier).
    """
    cut = df.withColumn("_chunk", chunk)
    parts = [*key, "_chunk"]
    inside = Window.partitionBy(*parts).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    across = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    summary = (
        cut.groupBy(*parts)
        .agg(rows.alias("_chunk_value"))
        .select(*(F.col(p).alias(f"_of{i}") for i, p in enumerate(parts)),
                chunks.over(across).alias("_carry"))
    )
    # A null key or chunk is a group like any other.
    same = [F.col(p).eqNullSafe(F.col(f"_of{i}")) for i, p in enumerate(parts)]
    return (
        cut.withColumn("_inside", rows.over(inside))
        .join(summary, same)
        .select(*df.columns, merge(F.col("_inside"), F.col("_carry")).alias(name))
    )
