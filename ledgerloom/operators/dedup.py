"""Duplicate removal within a batch and against history.

No step gathers the rows of one id in one task: ranking keeps one row per id
and task before the shuffle, and counting combines map-side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.rows import VALID
from ledgerloom.sources.landing import SOURCE_FILE, SOURCE_ROW

KEY = "transaction_id"


def dedup_first(
    df: DataFrame, key: str = KEY, order: Sequence[str] = (SOURCE_FILE, SOURCE_ROW)
) -> DataFrame:
    """Keep the first row of each key in the given total order.

    Filtering ``row_number = 1`` lets Spark keep only one candidate per key
    and task ahead of the exchange (WindowGroupLimit), hot keys included.
    """
    first = Window.partitionBy(key).orderBy(*order)
    ranked = df.withColumn("_rank", F.row_number().over(first))
    return ranked.where(F.col("_rank") == 1).drop("_rank")


def known_keys(df: DataFrame, existing: DataFrame, key: str = KEY) -> DataFrame:
    """Rows of history whose key occurs in the batch.

    Reducing history to the batch lets Spark test history rows against a
    broadcast (or runtime filter) of the batch keys while scanning, instead
    of shuffling all of history for every batch.
    """
    return existing.join(df.select(key).distinct(), key, "left_semi")


def drop_existing(df: DataFrame, existing: DataFrame, key: str = KEY) -> DataFrame:
    """Rows whose key is not in history yet."""
    return df.join(known_keys(df, existing.select(key), key), key, "left_anti")


def label_duplicates(
    valid: DataFrame, known: DataFrame | None = None, key: str = KEY, file: str = SOURCE_FILE
) -> DataFrame:
    """One row per file: rows read as valid, loaded, repeated within, known across.

    ``known`` holds the keys history has, as far as they occur in the batch.
    The first file in name order that holds a key loads it, unless it is
    known.  Further rows of a key in one file are ``within_file`` repeats;
    its first row in a file that does not load it is a ``cross_file`` repeat.
    """
    per_file_key = valid.groupBy(key, file).agg(F.count("*").alias("_rows"))
    per_file = per_file_key.groupBy(file).agg(
        F.sum("_rows").alias("valid_rows"), F.count("*").alias("_keys")
    )
    # Reading `_rows` here too keeps both branches alike: Spark then reuses one
    # exchange for them instead of grouping the batch twice.
    owners = per_file_key.groupBy(key).agg(F.min(file).alias(file), F.sum("_rows").alias("_rows"))
    if known is not None:
        owners = owners.join(known.select(key), key, "left_anti")
    loaded = owners.groupBy(file).agg(F.count_if(F.col("_rows") > 0).alias("loaded"))

    n = F.coalesce("loaded", F.lit(0))
    return per_file.join(loaded, file, "left").select(
        file,
        "valid_rows",
        n.alias("loaded"),
        (F.col("valid_rows") - F.col("_keys")).alias("within_file"),
        (F.col("_keys") - n).alias("cross_file"),
    )


def ingest_counts(
    labelled: DataFrame,
    known: DataFrame | None = None,
    key: str = KEY,
    file: str = SOURCE_FILE,
) -> DataFrame:
    """Per file of a validated batch: read = loaded + quarantined + skipped."""
    read = labelled.groupBy(file).agg(
        F.count("*").alias("rows_read"), F.count_if(~F.col(VALID)).alias("quarantined")
    )
    # Rows without a file meet no file below.  Said here, it holds for both groupings of
    # keys, and they share one exchange.
    valid = label_duplicates(labelled.where(F.col(VALID) & F.col(file).isNotNull()), known, key, file)
    zero = F.lit(0)
    return read.join(valid, file, "left").select(
        file,
        "rows_read",
        F.coalesce("loaded", zero).alias("loaded"),
        "quarantined",
        F.coalesce("within_file", zero).alias("within_file"),
        F.coalesce("cross_file", zero).alias("cross_file"),
        (F.coalesce("within_file", zero) + F.coalesce("cross_file", zero)).alias("skipped"),
    )


def run_totals(counts: DataFrame) -> DataFrame:
    """Totals of a run over its files."""
    return counts.agg(
        F.count("*").alias("files_processed"),
        F.coalesce(F.sum("loaded"), F.lit(0)).alias("records_loaded"),
        F.coalesce(F.sum("quarantined"), F.lit(0)).alias("records_quarantined"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("duplicates_skipped"),
    )
