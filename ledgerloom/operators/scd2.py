"""Account profiles and the slowly changing (type 2) account dimension."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import schemas
from ledgerloom.functions.exact import STATE, merge_state, state_value, sum_state
from ledgerloom.functions.ordered import number_rows
from ledgerloom.functions.text import number_text
from ledgerloom.operators.joins import version_number

PROFILE = [
    "primary_currency",
    "primary_category",
    "transaction_count",
    "total_spend",
    "first_seen",
    "last_seen",
]


def row_hash() -> Column:
    """MD5 over the six profile attributes, NULL counting as empty text."""
    texts = [
        number_text(F.col(name)) if name == "total_spend" else F.col(name).cast("string")
        for name in PROFILE
    ]
    return F.md5(F.concat_ws("|", *(F.coalesce(text, F.lit("")) for text in texts)))


def _mode(kind: str) -> Column:
    """Most frequent value; the alphabetically first one wins a tie."""
    ranked = F.struct((-F.col("_n")).alias("rank"), F.col("_value").alias("value"))
    return F.min(F.when(F.col("_kind") == kind, ranked))["value"]


def account_profiles(
    stg: DataFrame, run_dates: Sequence[date] | None = None, key: str = "account_id"
) -> DataFrame:
    """Behaviour of each account over its whole history, in one scan of the facts.

    With ``run_dates`` there is one profile per account and date, over the
    facts dated before it, still from one scan.

    Facts are first reduced to (account, currency, category) cells.  Map-side
    combining makes a hot account as small as any other there; only cells are
    then brought together by account, where every later step stays in place.
    """
    by = [key]
    cells = stg
    if run_dates is not None:
        dates = sorted(run_dates)
        first = F.lit(None).cast("int")
        for index in reversed(range(len(dates))):
            first = F.when(F.col("transaction_date") < F.lit(dates[index]), index).otherwise(first)
        cells = cells.where(F.col("transaction_date") < F.lit(dates[-1])).withColumn("_first", first)

    grain = [key, "currency", "category", *(["_first"] if run_dates is not None else [])]
    cells = (
        cells.groupBy(*grain)
        .agg(
            F.count("*").alias("_n"),
            F.min("transaction_date").alias("_min"),
            F.max("transaction_date").alias("_max"),
            *sum_state(F.col("amount")),
        )
        .repartition(key)
    )
    if run_dates is not None:
        by = [key, "run_date"]
        all_dates = F.array(*(F.lit(day) for day in dates))
        seen_by = F.slice(all_dates, F.col("_first") + 1, F.lit(len(dates)))
        cells = cells.withColumn("run_date", F.explode(seen_by))

    both = F.array(
        F.struct(F.lit("currency").alias("_kind"), F.col("currency").alias("_value")),
        F.struct(F.lit("category").alias("_kind"), F.col("category").alias("_value")),
    )
    values = (
        cells.select(*by, "_n", "_min", "_max", *STATE, F.inline(both))
        .groupBy(*by, "_kind", "_value")
        .agg(
            F.sum("_n").alias("_n"),
            F.min("_min").alias("_min"),
            F.max("_max").alias("_max"),
            *merge_state(),
        )
    )
    # Each fact is in one currency value and one category value: count it once.
    once = F.col("_kind") == "currency"
    profiles = (
        values.withColumns({name: F.when(once, F.col(name)) for name in STATE})
        .groupBy(*by)
        .agg(
            _mode("currency").alias("primary_currency"),
            _mode("category").alias("primary_category"),
            F.sum(F.when(once, F.col("_n"))).alias("transaction_count"),
            F.min("_min").alias("first_seen"),
            F.max("_max").alias("last_seen"),
            *merge_state(),
        )
        .withColumn("total_spend", state_value(*(F.col(name) for name in STATE)))
    )
    return profiles.select(*by, *PROFILE, row_hash().alias("row_hash"))


def _midnight(day: Column) -> Column:
    return day.cast("timestamp")


def _closing(run_date: Column, contiguous: bool) -> Column:
    """End of a version replaced on ``run_date``.

    The end is exclusive when facts are matched, so the default (the day
    before) leaves one uncovered day; ``contiguous`` closes it.
    """
    return _midnight(run_date if contiguous else F.date_sub(run_date, 1))


def scd2_step(
    open_rows: DataFrame,
    incoming: DataFrame,
    run_date: date,
    run_id: str,
    top: Column | int,
    key: str = "account_id",
    hash_col: str = "row_hash",
    contiguous: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """What one build does to the open versions: those it ends, and those open after it.

    Keys absent from ``incoming`` stay as they are, and the same profiles again change
    nothing.  Closed history is not looked at: ``top`` is the highest key given so far.
    """
    day = F.lit(run_date)
    held = open_rows.groupBy(key).agg(
        F.min(hash_col).alias("_low"), F.max(hash_col).alias("_high")
    )
    differs = (F.col("_low") != F.col(hash_col)) | (F.col("_high") != F.col(hash_col))
    verdict = incoming.join(held, key, "left")

    stale = verdict.where(differs).select(key)
    ended = open_rows.join(stale, key, "left_semi").withColumns({
        "valid_to": _closing(day, contiguous), "is_current": F.lit(False),
    })
    new = verdict.where(F.col("_low").isNull() | differs).select(*incoming.columns)
    added = number_rows(new, [key], "account_sk", top).withColumns({
        "valid_from": _midnight(day),
        "valid_to": F.lit(None).cast("timestamp"),
        "is_current": F.lit(True),
        "run_id": F.lit(run_id),
    })
    columns = schemas.DIM_ACCOUNTS.names
    kept = open_rows.join(stale, key, "left_anti").select(*columns)
    return ended.select(*columns), kept.unionByName(added.select(*columns))


def scd2_merge(
    current: DataFrame,
    incoming: DataFrame,
    run_date: date,
    run_id: str,
    key: str = "account_id",
    hash_col: str = "row_hash",
    contiguous: bool = False,
) -> DataFrame:
    """The dimension after one build: changed rows closed, new versions added.

    Closed history is passed through without any join; see :func:`scd2_step`.
    """
    top = current.agg(F.coalesce(F.max("account_sk"), F.lit(0))).scalar()
    ended, remaining = scd2_step(
        current.where("is_current"), incoming, run_date, run_id, top, key, hash_col, contiguous
    )
    closed = current.where(~F.col("is_current")).select(*schemas.DIM_ACCOUNTS.names)
    return closed.unionByName(ended).unionByName(remaining)


def scd2_from_snapshots(
    profiles: DataFrame,
    key: str = "account_id",
    hash_col: str = "row_hash",
    run_date_col: str = "run_date",
    contiguous: bool = False,
    run_id: Column | None = None,
) -> DataFrame:
    """All versions at once from the profiles of every run date.

    Equal to merging the snapshots one by one, because the current row always
    carries the hash of the last snapshot that held the key.  A key has at most
    one row per run date, which bounds each window group by the list of dates.
    """
    in_time = Window.partitionBy(key).orderBy(run_date_col)
    before = F.lag(hash_col).over(in_time)
    starts = (
        profiles.withColumn("_before", before)
        .where(F.col("_before").isNull() | (F.col("_before") != F.col(hash_col)))
        .withColumn("_next", F.lead(run_date_col).over(in_time))
    )
    day = F.col(run_date_col)
    label = F.concat(F.lit("run-"), day.cast("string")) if run_id is None else run_id
    versions = starts.withColumns({
        "valid_from": _midnight(day),
        "valid_to": _closing(F.col("_next"), contiguous),
        "is_current": F.col("_next").isNull(),
        "run_id": label,
    }).drop("_before", "_next")
    numbered = number_rows(versions, [run_date_col, key], "account_sk")
    return numbered.select(*schemas.DIM_ACCOUNTS.names)


def scd2_counts(merged: DataFrame, incoming: DataFrame, run_id: str) -> DataFrame:
    """Profiles processed, versions opened by this run, and profiles left unchanged."""
    opened = merged.agg(
        F.count_if((F.col("run_id") == run_id) & F.col("is_current"))
    ).scalar()
    return incoming.agg(F.count("*").alias("accounts_processed")).select(
        F.lit(run_id).alias("run_id"),
        "accounts_processed",
        opened.alias("new_versions"),
        (F.col("accounts_processed") - opened).alias("unchanged"),
    )


def account_history(dim: DataFrame, as_of: date | Column | None = None) -> DataFrame:
    """Every version with its number and length in days.

    Current versions are measured up to ``as_of`` (today by default).
    """
    if as_of is None:
        as_of = F.current_date()
    today = as_of if isinstance(as_of, Column) else F.lit(as_of)
    end = F.when(F.col("is_current"), today).otherwise(F.to_date("valid_to"))
    columns = [
        "account_sk", "account_id", *PROFILE, "valid_from", "valid_to", "is_current",
        "version_number",
    ]
    return version_number(dim).select(
        *columns, F.datediff(end, F.to_date("valid_from")).alias("version_duration_days")
    )

