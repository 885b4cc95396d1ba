"""The k smallest distinct values of every column, in one scan."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _rank(value):
    """A sort key with Spark's order: null first in nested values, NaN last."""
    if isinstance(value, float):
        return (1, math.isnan(value), 0.0 if math.isnan(value) else value)
    if isinstance(value, (list, tuple)):
        return (1, [_rank(v) for v in value])
    if isinstance(value, dict):
        return (1, [_rank(v) for v in value.values()])
    if isinstance(value, str):
        return (1, value.encode())
    return (0,) if value is None else (1, value)


def _least(values: pa.Array, k: int) -> pa.Array:
    """At most k values: the smallest distinct ones that are not null."""
    values = values.drop_null()
    kind = values.type
    if pa.types.is_nested(kind) or pa.types.is_boolean(kind) or pa.types.is_decimal(kind):
        distinct = {repr(v): v for v in values.to_pylist()}.values()
        return pa.array(sorted(distinct, key=_rank)[:k], kind)
    if pa.types.is_floating(kind):
        # Zero has two signs but is one value, and NaN is the largest.
        numbers = np.unique(values.to_numpy() + 0.0)
        return pa.array(numbers[:k], kind, from_pandas=False)
    distinct = pc.unique(values)
    return distinct.take(pc.select_k_unstable(distinct, k, [("", "ascending")])) if len(distinct) else distinct


def _states(names: Sequence[str], k: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, pa.Array] = {}
        for batch in batches:
            for name in names:
                least = _least(batch.column(name), k)
                held[name] = _least(pa.concat_arrays([held[name], least]), k) if name in held else least
            # What batches leave would stay with the worker, which outlives its tasks.
            batch = least = None
            pa.default_memory_pool().release_unused()
        if held:
            yield pa.RecordBatch.from_pydict({
                n: pa.ListArray.from_arrays(pa.array([0, len(v)], pa.int32()), v) for n, v in held.items()
            })

    return read


def smallest(df: DataFrame, names: Sequence[str], k: int) -> DataFrame:
    """One row: for each column an array of its ``k`` smallest distinct values, ascending.

    A task keeps ``k`` values a column and passes on one row, so the states that meet
    are ``k`` values a task, whatever the data.  Values that are null do not count; NaN is
    the largest.  Columns must have an order.
    """
    picked = df.select(*names)
    shape = T.StructType([T.StructField(f.name, T.ArrayType(f.dataType)) for f in picked.schema])
    states = picked.mapInArrow(_states(names, k), shape)
    merged = [
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list(n)))), 1, k).alias(n) for n in names
    ]
    return states.agg(*merged)
