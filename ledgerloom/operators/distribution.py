"""Distribution of values: shares, moments, medians and dependencies."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.exact import exact_sum


def value_shares(df: DataFrame, column: str) -> DataFrame:
    """Rows and share of all rows per value."""
    counts = df.groupBy(column).agg(F.count("*").alias("row_count"))
    # The sum of the counts, so the rows are read once.
    total = counts.agg(F.sum("row_count")).scalar()
    return counts.withColumn("share", F.col("row_count") / total)


def distinct_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("distinct_count"))


#: Values that one task may sort.
_FEW = 2_000
#: Rank accuracy of a sketch: one part in so many.
_SKETCH = 1_000


def rank_values(df: DataFrame, column: str, ranks: Sequence[int]) -> list:
    """The values at the given 1-based ranks, exact, without sorting the column.

    Each round a quantile sketch names an interval around a rank, and one count says
    how many values lie below it and in it.  Sketches of parts merge, so a round is one
    scan with a small state from each task, and each leaves about a 500th of the
    values, however they are spread; the last few are sorted as one short array.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v"))
    found = []
    for rank in ranks:
        inside, below = values, 0
        n = inside.count()
        while True:
            if n <= _FEW:
                held = inside.agg(F.sort_array(F.collect_list("v")).alias("v")).first().v
                found.append(held[rank - below - 1])
                break
            at = (rank - below) / n
            shares = [max(0.0, at - 2 / _SKETCH), min(1.0, at + 2 / _SKETCH)]
            low, high = inside.agg(F.percentile_approx("v", shares, _SKETCH * 2).alias("q")).first().q
            under, upto, equal = inside.agg(
                F.count_if(F.col("v") < low), F.count_if(F.col("v") <= high), F.count_if(F.col("v") == low)
            ).first()
            if below + under < rank <= below + under + equal:
                found.append(low)
                break
            if not below + under < rank <= below + upto:
                # A sketch that missed its accuracy: take the side the rank is on.
                left = rank <= below + under
                inside = inside.where(F.col("v") < low if left else F.col("v") > high)
                below, n = (below, under) if left else (below + upto, n - upto)
                continue
            inside = inside.where(F.col("v").between(low, high))
            below, n = below + under, upto - under
            if low == high:
                found.append(low)
                break
    return found


def median(df: DataFrame, column: str) -> DataFrame:
    """Exact median as one row; NULL without values."""
    total = df.agg(F.count(column)).first()[0]
    middle = None
    if total:
        ranks = sorted({(total + 1) // 2, (total + 2) // 2})
        values = rank_values(df, column, ranks)
        middle = (values[0] + values[-1]) / 2
    return df.sparkSession.range(1).select(F.lit(middle).cast("double").alias("median"))


def shape(df: DataFrame, column: str) -> DataFrame:
    """Mean, median, population skewness and number of values that are not positive."""
    value = F.col(column)
    middle = median(df, column).scalar()
    return df.agg(
        (exact_sum(value) / F.count(column)).alias("mean"),
        F.skewness(column).alias("skewness"),
        F.count_if(~(value > 0)).alias("non_positive"),
    ).select("mean", middle.alias("median"), "skewness", "non_positive")


def functional_dependency(
    df: DataFrame, a: str, b: str, count: str = "value_count"
) -> DataFrame:
    """Values of ``a`` that occur with more than one value of ``b``."""
    return df.groupBy(a).agg(F.count_distinct(b).alias(count)).where(F.col(count) > 1)
