"""Structured Streaming forms of ingestion and of the daily mart."""

from __future__ import annotations

import time
from datetime import UTC, datetime
from hashlib import sha256

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ledgerloom import schemas
from ledgerloom.operators.marts import DAILY_GRAIN, daily_spend
from ledgerloom.operators.runs import audit_row
from ledgerloom.plans.ingest import Warehouse, load_files
from ledgerloom.session import configure, freed_shuffles, scratch, stage
from ledgerloom.sources.files import child_names, delete
from ledgerloom.sources.landing import hash_files, listed
from ledgerloom.sources.manifest import pending_files
from ledgerloom.sources.tables import (
    Version,
    commit,
    expire,
    head,
    read_partitioned,
    read_parts,
    write_part,
)

BATCH = "batch_id"
#: Fixed: what Spark's binary source gives of a file; its content is never asked for.
_BINARY_FILE = "path string, modificationTime timestamp, length long, content binary"


def landing_stream(spark: SparkSession, directory: str, files_per_batch: int = 1000) -> DataFrame:
    """New landing files as a stream of the listing: name, path, size and time.

    The files themselves are read by the batch that loads them, after the audit of
    their footers; a stream of their rows would break at the first bad file.
    """
    stream = (
        spark.readStream.format("binaryFile").schema(_BINARY_FILE)
        .option("pathGlobFilter", "*.parquet")
        .option("maxFilesPerTrigger", files_per_batch)
        .load(directory)
    )
    return listed(stream)


def ingest_stream(
    spark: SparkSession,
    directory: str,
    house: Warehouse,
    checkpoint: str,
    files_per_batch: int = 1000,
) -> StreamingQuery:
    """Load every file not picked up before, through the batch operators, then stop.

    Each batch audits, reads and records its files as a run does, so a bad file fails
    alone and enters the manifest.  The checkpoint remembers the files, and names the
    stream in its run ids, so streams into one warehouse never share one.  A batch
    repeated after a failure carries the same run id, replaces its quarantine partition
    and skips the ids it already loaded.  Each batch leaves an audit row.
    """
    stream_id = sha256(checkpoint.rstrip("/").encode()).hexdigest()[:16]

    def load(batch: DataFrame, batch_id: int) -> None:
        run_id, at = f"stream-{stream_id}-{batch_id:08d}", datetime.now(UTC)
        started = time.monotonic()
        shape = schemas.INGESTION_RUNS
        counters = dict.fromkeys((f.name for f in shape if f.dataType.typeName() == "long"), 0)
        session = batch.sparkSession  # a session of its own: what it stages is read in the warehouse's
        with scratch(session), freed_shuffles(session), freed_shuffles(house.spark):
            files = stage(hash_files(batch), "files")
            held = house.published("file_manifest", schemas.FILE_MANIFEST)
            pending = stage(pending_files(files, held), "pending")
            listed_files, chosen = files.count(), pending.count()
            counters |= {"files_checked": listed_files, "files_skipped": listed_files - chosen}
            if chosen:
                counters |= load_files(house, pending, run_id, at, directory)
        house.log("ingestion_runs", audit_row(
            batch.sparkSession, shape, run_id=run_id, started_at=at,
            completed_at=datetime.now(UTC), status="completed",
            elapsed_seconds=time.monotonic() - started, **counters,
        ))

    configure(spark)
    return (
        landing_stream(spark, directory, files_per_batch)
        .writeStream.foreachBatch(load)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dedup_stream(
    stream: DataFrame, delay: str, key: str = "transaction_id", ts: str = "timestamp"
) -> DataFrame:
    """Drop repeats that arrive within the watermark delay, with bounded state.

    Older repeats pass, so this only thins a stream; the load itself still
    compares with all of history.
    """
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def daily_spend_stream(stream: DataFrame) -> DataFrame:
    """The daily mart over a stream of staged rows; emits the groups each batch changed."""
    return daily_spend(stream)


#: Batches whose states are kept one by one before they become a base.
COMPACTED_EVERY = 16
_BASE, _THROUGH = "_base", "through"
_STATES = (
    "transaction_date date, category string, currency string, total_amount double, "
    "transaction_count long, avg_amount double, batch_id long"
)


def write_daily_spend(
    stream: DataFrame, path: str, checkpoint: str, every: int = COMPACTED_EVERY
) -> StreamingQuery:
    """Keep the changed groups of every batch; a repeated batch replaces its own.

    After ``every`` batches their states are folded into the base.
    """

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")
        if batch_id - _base(stream.sparkSession, path)[1] >= every:
            compact_daily_spend(stream.sparkSession, path, batch_id)

    return (
        daily_spend_stream(stream)
        .writeStream.outputMode("update")
        .foreachBatch(save)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def _base(spark: SparkSession, path: str) -> tuple[Version, int]:
    """The base and the last batch that is in it."""
    base = head(spark, f"{path}/{_BASE}") or Version(notes={_THROUGH: -1})
    return base, base.notes[_THROUGH]


def _states(spark: SparkSession, path: str) -> DataFrame:
    """The newest state of each group, from the base and the batches after it."""
    base, through = _base(spark, path)
    shape = spark.createDataFrame([], _STATES).schema
    later = read_partitioned(spark, path, shape).where(F.col(BATCH) > through)
    known = read_parts(spark, f"{path}/{_BASE}", base.folders(), shape)
    values = [c for c in shape.names if c not in (*DAILY_GRAIN, BATCH)]
    newest = F.max(F.struct(BATCH, *values)).alias("s")
    return known.unionByName(later).groupBy(*DAILY_GRAIN).agg(newest).select(
        *DAILY_GRAIN, *(F.col(f"s.{name}").alias(name) for name in (*values, BATCH))
    )


def compact_daily_spend(spark: SparkSession, path: str, through: int) -> None:
    """Fold all states into a base that holds the batches up to ``through``.

    The base counts from its commit on.  States of batches go once the base before,
    too, held them, so that a reader that began on that one still finds its files; a
    batch repeated later writes states that no reader looks at.
    """
    base, before = _base(spark, path)
    root = f"{path}/{_BASE}"
    folder = write_part(_states(spark, path).where(F.col(BATCH) <= through), root)
    made = Version(base.number + 1, {"rows": [folder]}, {_THROUGH: through})
    if not commit(spark, root, made):
        delete(spark, f"{root}/{folder}")
        return
    expire(spark, root, 2)
    for name in child_names(spark, path):
        if name.startswith(f"{BATCH}=") and int(name.partition("=")[2]) <= before:
            delete(spark, f"{path}/{name}")


def read_daily_spend(spark: SparkSession, path: str) -> DataFrame:
    """The mart as of the last batch: the newest state of each group."""
    return _states(spark, path).drop(BATCH)
