"""Interval joins between facts and a versioned dimension."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions.ordered import before_in_group
from ledgerloom.session import stage

# The end of an open validity interval.
OPEN_END = "9999-12-31 23:59:59"
OVERLAP_OPEN_END = "9999-12-31 00:00:00"


def _open(end: str | Column, far: str = OPEN_END) -> Column:
    return F.coalesce(end, F.lit(far).cast("timestamp"))


def heavy_keys(weights: DataFrame, key: str, weight: str, share: float = 1 / 256) -> DataFrame:
    """Keys that own at least ``share`` of the total weight.

    At most ``1 / share`` keys can, so the result has a proven bound and may
    be broadcast whatever the size of the data.
    """
    total = weights.agg(F.sum(weight).alias("total")).scalar()
    return (
        weights.groupBy(key)
        .agg(F.sum(weight).alias("_weight"))
        .where(F.col("_weight") >= total * share)
        .select(key)
    )


def _salted(
    fact: DataFrame, dim: DataFrame, key: str, heavy: DataFrame, salts: int, by: Column
) -> tuple[DataFrame, DataFrame]:
    """Spread the facts of heavy keys over ``salts`` buckets and copy their versions to each."""
    marks = F.broadcast(heavy.select(key, F.lit(True).alias("_heavy")))
    is_heavy = F.coalesce("_heavy", F.lit(False))
    bucket = F.pmod(F.xxhash64(by), F.lit(salts)).cast("int")
    every = F.sequence(F.lit(0), F.lit(salts - 1))
    facts = fact.join(marks, key, "left").withColumn("_salt", F.when(is_heavy, bucket).otherwise(0))
    copies = dim.join(marks, key, "left").withColumn(
        "_salt", F.explode(F.when(is_heavy, every).otherwise(F.array(F.lit(0))))
    )
    return facts.drop("_heavy"), copies.drop("_heavy")


def pit_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str = "account_id",
    ts: str = "transaction_timestamp",
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
    sk: str = "account_sk",
    unknown: int | None = -1,
    heavy: DataFrame | None = None,
    salts: int = 64,
    salt_by: str = "transaction_id",
) -> DataFrame:
    """Add the surrogate key of the version valid at each fact's time.

    Intervals are half-open; a fact no version covers gets ``unknown``
    (``None`` leaves it NULL).  Facts of keys with many versions go by ``asof_join``,
    so that none meets more than one; all others by ``range_join``, whose fan-out is
    then at most ``FEW`` (but for a broken dimension, whose overlapping versions all
    match).  Keys with many versions are written first: where there are none, facts are
    dealt out once, for the range join alone.
    """
    names = (key, ts, valid_from, valid_to, sk, unknown)
    many = stage(crowded_keys(dim, key, valid_from, valid_to), "crowded")
    if not many.take(1):
        return range_join(fact, dim, *names, heavy, salts, salt_by)
    one = fact.join(many, key, "left_semi").select(*fact.columns)
    others = fact.join(many, key, "left_anti").select(*fact.columns)
    few = range_join(others, dim, *names, heavy, salts, salt_by)
    crowded = asof_join(one, dim.join(many, key, "left_semi"), *names)
    return few.unionByName(crowded)


def range_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    ts: str,
    valid_from: str,
    valid_to: str,
    sk: str,
    unknown: int | None = -1,
    heavy: DataFrame | None = None,
    salts: int = 64,
    salt_by: str = "transaction_id",
) -> DataFrame:
    """An equi-join with a range residual: every version of a fact's key is looked at.

    A dimension below the broadcast threshold by its measured size is broadcast,
    a larger one meets the facts on the key.  There, adaptive execution splits
    oversized partitions; facts of keys named in ``heavy`` (at most a few
    hundred, see ``heavy_keys``) are salted up front.
    """
    versions = dim.select(
        F.col(key),
        F.col(valid_from).alias("_from"),
        _open(valid_to).alias("_to"),
        F.col(sk).alias("_sk"),
    )
    facts, on = fact, [key]
    if heavy is not None:
        facts, versions = _salted(fact, versions, key, heavy, salts, F.col(salt_by))
        on = [key, "_salt"]
    f, d = facts.alias("f"), versions.alias("d")
    match = (F.col(f"f.{ts}") >= F.col("d._from")) & (F.col(f"f.{ts}") < F.col("d._to"))
    for name in on:
        match = match & (F.col(f"f.{name}") == F.col(f"d.{name}"))
    found = F.col("d._sk") if unknown is None else F.coalesce("d._sk", F.lit(unknown).cast("long"))
    return f.join(d, match, "left").select(
        *(F.col(f"f.{c}") for c in fact.columns if c != sk), found.alias(sk)
    )


#: More versions than these make a key crowded.
FEW = 16


def crowded_keys(dim: DataFrame, key: str, valid_from: str, valid_to: str) -> DataFrame:
    """Keys of more than ``FEW`` versions that do not overlap."""
    before = Window.partitionBy(key).orderBy("_from").rowsBetween(Window.unboundedPreceding, -1)
    return (
        _covering(dim, key, valid_from, valid_to)
        .withColumn("_overlaps", F.coalesce(F.max("_to").over(before) > F.col("_from"), F.lit(False)))
        .groupBy(key).agg(F.count("*").alias("_n"), F.max("_overlaps").alias("_any"))
        .where((F.col("_n") > FEW) & ~F.col("_any")).select(key)
    )


def _covering(dim: DataFrame, key: str, valid_from: str, valid_to: str, *more: str) -> DataFrame:
    """Versions that cover any time at all."""
    rows = dim.select(key, F.col(valid_from).alias("_from"), _open(valid_to).alias("_to"), *more)
    return rows.where((F.col("_to") > F.col("_from")) & F.col(key).isNotNull())


def asof_join(
    fact: DataFrame,
    dim: DataFrame,
    key: str,
    ts: str,
    valid_from: str,
    valid_to: str,
    sk: str,
    unknown: int | None = -1,
) -> DataFrame:
    """The version that began last at each fact's time, if it still holds.

    Facts and beginnings of versions stand in one order; the last beginning is carried
    forward, within months of a key by one window and over the months by another on
    one row a month.  So each fact meets one version, and a key that owns a third of
    the facts is spread over its months.  Versions of a key must not overlap; facts
    need a key.
    """
    begin = F.struct(F.col("_from").alias("from"), F.col("_to").alias("to"), F.col(sk).alias("sk"))
    starts = _covering(dim, key, valid_from, valid_to, sk).select(
        key, F.lit(None).alias("_fact"), F.col("_from").alias("_at"), begin.alias("_begin")
    )
    rows = fact.select(
        key, F.struct(*fact.columns).alias("_fact"), F.col(ts).cast("timestamp").alias("_at"),
        F.lit(None).alias("_begin"),
    ).unionByName(starts)
    month = F.coalesce(F.trunc("_at", "MM"), F.lit("0001-01-01").cast("date"))
    # Dealt out by month too: a window alone would be content with the key.
    rows = rows.withColumn("_month", month).repartition(key, "_month")
    inside = (
        Window.partitionBy(key, "_month").orderBy("_at", F.col("_begin").isNull())
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    across = Window.partitionBy(key).orderBy("_month").rowsBetween(Window.unboundedPreceding, -1)
    months = rows.groupBy(key, "_month").agg(F.max("_begin").alias("_last"))
    carried = months.select(key, "_month", F.max("_last").over(across).alias("_carried"))
    last = F.coalesce("_inside", "_carried")
    found = F.when(last["to"] > F.col("_at"), last["sk"])
    if unknown is not None:
        found = F.coalesce(found, F.lit(unknown).cast("long"))
    return (
        rows.withColumn("_inside", F.max("_begin").over(inside))
        .where(F.col("_fact").isNotNull())
        .join(carried, [key, "_month"])
        .select(*(F.col("_fact")[c].alias(c) for c in fact.columns if c != sk), found.alias(sk))
    )


def overlapping_pairs(
    dim: DataFrame,
    key: str = "account_id",
    sk: str = "account_sk",
    valid_from: str = "valid_from",
    valid_to: str = "valid_to",
) -> DataFrame:
    """Pairs of versions of one key whose validity ranges overlap, each once.

    Of two overlapping ranges the later begins before the earlier ends.  So a sweep
    over beginnings and ends suffices: beginnings are numbered within their key, each
    end counts the beginnings before it, and the numbers between a range's own and that
    count are the ranges it overlaps.  Only those are then fetched, one row a pair,
    however many versions the key has.  Both counts run in months of a key, with the
    count of earlier months added.  A healthy dimension has no such numbers.
    """
    rows = dim.select(
        F.col(key),
        F.col(sk).alias("_sk"),
        F.col(valid_from).alias("_from"),
        _open(valid_to, OVERLAP_OPEN_END).alias("_to"),
    ).where(F.col(key).isNotNull() & F.col("_sk").isNotNull() & F.col("_from").isNotNull())
    begun = stage(_counted_before(rows, key, "_from", ["_from", "_sk"], F.count(F.lit(1)), "_at"), "begun")
    # An end comes before a beginning at the same instant: ranges are half-open.
    none = F.lit(None)
    marks = begun.select(
        key, F.col("_from").alias("_time"), F.lit(1).alias("_begins"),
        none.alias("_own"), none.alias("_own_sk"), none.alias("_own_from"),
    )
    ends = begun.select(
        key, F.col("_to").alias("_time"), F.lit(0).alias("_begins"),
        F.col("_at").alias("_own"), F.col("_sk").alias("_own_sk"), F.col("_from").alias("_own_from"),
    )
    counted = _counted_before(
        marks.unionByName(ends), key, "_time", ["_time", "_begins", "_own"], F.sum("_begins"), "_until"
    )
    earlier = counted.where((F.col("_begins") == 0) & (F.col("_until") > F.col("_own") + 1))
    wanted = earlier.select(
        F.col(key).alias("_key"), "_own_sk", "_own_from",
        F.explode(F.sequence(F.col("_own") + 1, F.col("_until") - 1)).alias("_number"),
    )
    pairs = wanted.join(
        begun, (F.col("_key") == F.col(key)) & (F.col("_number") == F.col("_at"))
    ).where((F.col("_own_from") < F.col("_to")) & (F.col("_sk") != F.col("_own_sk")))
    return pairs.select(
        key, F.least("_sk", "_own_sk").alias(sk), F.greatest("_sk", "_own_sk").alias(f"b_{sk}")
    )


def _counted_before(df, key, time, order, rows, name) -> DataFrame:
    """Add what ``rows`` counts of the rows of a key that come before, month by month."""
    return before_in_group(
        df, [key], F.trunc(time, "MM"), order, name, rows=rows, chunks=F.sum("_chunk_value"),
        merge=lambda inside, before: F.coalesce(inside, F.lit(0)) + F.coalesce(before, F.lit(0)),
    )


def latest_row(df: DataFrame, ts: str = "started_at", tie: str = "run_id") -> DataFrame:
    """The newest row; a top-1 per partition, then over partitions."""
    return df.orderBy(F.desc(ts), tie).limit(1)


def latest_run_rows(rows: DataFrame, runs: DataFrame, run_id: str = "run_id") -> DataFrame:
    """Rows that belong to the newest run."""
    return rows.join(latest_row(runs).select(run_id), run_id)


def version_number(
    dim: DataFrame, key: str = "account_id", valid_from: str = "valid_from", sk: str = "account_sk"
) -> DataFrame:
    """Number the versions of each key from 1 by start of validity, by month chunks."""
    earlier = before_in_group(
        dim,
        [key],
        F.trunc(valid_from, "MM"),
        [valid_from, sk],
        "_earlier",
        rows=F.count(F.lit(1)),
        chunks=F.sum("_chunk_value"),
        merge=lambda inside, before: inside + F.coalesce(before, F.lit(0)),
    )
    return earlier.withColumn("version_number", (F.col("_earlier") + 1).cast("int")).drop("_earlier")
