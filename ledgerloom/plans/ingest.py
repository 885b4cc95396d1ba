"""The ingestion run: landing directory to raw table and quarantine."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from contextvars import copy_context
from dataclasses import dataclass
from datetime import UTC, date, datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas
from ledgerloom.operators.dedup import KEY, dedup_first, ingest_counts, run_totals
from ledgerloom.operators.rows import (
    REASON,
    REASONS,
    VALID,
    date_slice,
    enrich,
    split,
    to_quarantine,
    validate,
)
from ledgerloom.operators.runs import audit_row, latest_events, run_started
from ledgerloom.session import configure, freed_shuffles, scratch, stage
from ledgerloom.sources import manifest as M
from ledgerloom.sources.key_index import KeyIndex
from ledgerloom.sources.landing import (
    SOURCE_FILE,
    SOURCE_ROW,
    damaged_files,
    hash_files,
    landing_files,
    read_audited,
    schema_errors,
)
from ledgerloom.sources.tables import (
    append_partitioned,
    latest,
    publish,
    read_partitioned,
    replace_partitions,
    update,
)

MONTH = "transaction_month"
_MONTH_COLUMN = T.StructType([T.StructField(MONTH, T.DateType())])


@dataclass(frozen=True)
class Warehouse:
    """Where the tables of one warehouse live.

    ``transactions`` is laid out by month and appended to; the other tables are
    either appended per run or published as whole versions.
    """

    spark: SparkSession
    root: str

    def path(self, table: str) -> str:
        return f"{self.root.rstrip('/')}/{table}"

    def transactions(
        self, first: date | str | None = None, last: date | str | None = None
    ) -> DataFrame:
        """The raw table, or a closed range of its dates.

        A range prunes month folders, and row groups by date inside them.
        """
        rows = read_partitioned(
            self.spark, self.path("transactions"), schemas.TRANSACTIONS, _MONTH_COLUMN
        )
        if first is not None and last is not None:
            months = [F.trunc(F.lit(day).cast("date"), "MM") for day in (first, last)]
            rows = date_slice(rows, first, last).where(F.col(MONTH).between(*months))
        return rows.drop(MONTH)

    def append_transactions(self, df: DataFrame) -> None:
        """Append the 13 columns, by month folder and sorted by date within it."""
        self._append(df.select(*schemas.TRANSACTIONS.names), "transaction_date", lambda rows: rows)

    def append_landed(self, df: DataFrame, run_id: str, at: datetime) -> None:
        """Append landed rows; what ``enrich`` adds to them is not dealt out with them."""
        names = [*schemas.LANDING.names, SOURCE_FILE]
        self._append(df.select(*names), F.to_date("timestamp"), lambda rows: enrich(rows, run_id, at))

    def _append(self, df: DataFrame, day: Column | str, add: Callable[[DataFrame], DataFrame]) -> None:
        append_partitioned(
            df.withColumn(MONTH, F.trunc(day, "MM")), self.path("transactions"), MONTH,
            ["transaction_date", "transaction_id"],
            lambda rows: add(rows).withColumn(MONTH, F.trunc("transaction_date", "MM")),
        )

    def quarantine(self) -> DataFrame:
        return read_partitioned(self.spark, self.path("quarantine"), schemas.QUARANTINE)

    def events(self, table: str, schema) -> DataFrame:
        """The audit table as logged: a row when a run begins and one when it ends."""
        return read_partitioned(self.spark, self.path(table), schema)

    def runs(self, table: str, schema) -> DataFrame:
        """An audit table; of runs, one row each: how it ended, or that it is running."""
        events = self.events(table, schema)
        return latest_events(events) if table.endswith("_runs") else events

    def log(self, table: str, row: DataFrame) -> None:
        row.coalesce(1).write.mode("append").parquet(self.path(table))

    def published(self, table: str, schema) -> DataFrame:
        return latest(self.spark, self.path(table), schema)

    def publish(self, table: str, df: DataFrame, sort=()) -> DataFrame:
        return publish(df, self.path(table), sort)

    def update(self, table: str, schema, change) -> DataFrame:
        """Replace a table by what ``change`` makes of it, keeping other writers' changes."""
        return update(self.spark, self.path(table), schema, change)

    def known_ids(self) -> KeyIndex:
        """The index of loaded ids, brought up to date with the raw table.

        A warehouse without one gets it from the rows it has.  Runs that ended between
        loading and indexing are read again by their run id; nothing else is.
        """
        index = KeyIndex(self.spark, self.path("known_ids"), KEY)
        loaded = self.transactions().select(KEY, F.col("run_id").alias("part"))
        if not index.exists():
            index.rebuild(loaded)
        for run_id in index.unfinished():
            ids = stage(loaded.where(F.col("part") == run_id), "unfinished")
            if ids.take(1):
                index.add(ids, run_id)
                index.end(run_id)
        return index


def write_batch(
    house: Warehouse, landed: DataFrame, run_id: str, at: datetime, audit: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Validate, quarantine, deduplicate, enrich and append the files of one audit.

    Returns counts per file, and the files that broke while they were read, of which
    no row is kept.

    The judged batch is written once, apart by verdict, so that quarantine,
    keys and counts each read only the columns they need.  Ids are looked up in the
    index of known ids, which reads few of its buckets and never the history itself.
    Loading drops ids history already has, and quarantine replaces its run's
    partition: a repeated batch leaves the same tables.  A run is noted as open from
    before it loads until its ids are in the index, so no loaded id gets lost.
    """
    verdict = validate(landed)
    judged = stage(
        verdict.withColumn(REASON, F.when(~F.col(VALID), F.col(REASON))).drop(REASONS),
        "judged", partition_by=[VALID],
    )
    damaged = stage(damaged_files(judged, audit), "damaged")
    if damaged.take(1):
        broken = damaged.select(F.col("file_path").alias(SOURCE_FILE))
        judged = judged.join(broken, SOURCE_FILE, "left_anti").select(*judged.columns)
    valid, invalid = split(judged)
    index = house.known_ids()
    found = index.known(valid.select(KEY))
    known = stage(found.select(KEY, (F.col("part") == run_id).alias("own")), "known_keys")

    def count() -> DataFrame:
        # A repeat of this run must not count its own earlier rows as history.
        return stage(ingest_counts(judged, known.where(~F.col("own"))), "counts")

    def reject() -> None:
        last = house.quarantine().where(F.col("run_id") != run_id).agg(
            F.coalesce(F.max("quarantine_id"), F.lit(0)).alias("id")
        ).first().id
        replace_partitions(
            to_quarantine(invalid, run_id, at, last), house.path("quarantine"), "run_id"
        )

    def load() -> None:
        fresh = stage(dedup_first(valid).drop(SOURCE_ROW).join(known, KEY, "left_anti"), "fresh")
        own = known.where("own").select(KEY)
        index.begin(run_id)
        house.append_landed(fresh, run_id, at)
        # A repeat adds what its first attempt had loaded, too: parts are replaced.
        index.add(fresh.select(KEY).unionAll(own), run_id)
        index.end(run_id)

    # The three read the same staged tables and do not wait for each other.
    with ThreadPoolExecutor(max_workers=3) as pool:
        jobs = [pool.submit(copy_context().run, job) for job in (count, reject, load)]
        counts, *_ = [job.result() for job in jobs]
    return counts, damaged


def run_ingest(
    house: Warehouse,
    source_dir: str,
    run_id: str | None = None,
    at: datetime | None = None,
    mode: str = "hash",
    full_refresh: bool = False,
) -> DataFrame:
    """One incremental ingestion run; returns its audit row.

    Files whose schema does not conform, or that cannot be read, fail alone.
    A full refresh reads every file again, but rows already loaded stay and
    their ids are skipped.
    """
    spark = configure(house.spark)
    run_id = run_id or uuid.uuid4().hex
    at = at or datetime.now(UTC)
    started = time.monotonic()
    runs, shape = "ingestion_runs", schemas.INGESTION_RUNS
    house.log(runs, run_started(spark, shape, run_id, at))

    counters: dict[str, int] = {}
    status = "failed"
    try:
        with scratch(spark), freed_shuffles(spark):
            counters = _ingest(house, source_dir, run_id, at, mode, full_refresh)
        status = "completed"
    finally:
        elapsed = time.monotonic() - started
        row = audit_row(
            spark, shape, run_id=run_id, started_at=at, completed_at=datetime.now(UTC),
            status=status, elapsed_seconds=elapsed,
            **{f.name: counters.get(f.name, 0) for f in shape if f.dataType.typeName() == "long"},
        )
        house.log(runs, row)
    return row


def _ingest(
    house: Warehouse, source_dir: str, run_id: str, at: datetime, mode: str, full_refresh: bool
) -> dict[str, int]:
    spark = house.spark
    manifest = house.published("file_manifest", schemas.FILE_MANIFEST)
    metadata = house.published("manifest_metadata", schemas.MANIFEST_METADATA)
    if full_refresh:
        manifest = house.update(
            "file_manifest", schemas.FILE_MANIFEST, lambda held: M.reset_manifest(held, run_id, at)
        )
        metadata = house.update(
            "manifest_metadata", schemas.MANIFEST_METADATA,
            lambda held: M.drop_watermark(held, source_dir),
        )

    watermark = M.read_watermark(metadata, source_dir) if mode == "watermark" else None
    checked = landing_files(spark, source_dir).count()
    files = landing_files(spark, source_dir, newer_than=watermark)
    if mode != "hash" and not full_refresh:
        files = M.changed_files(files, manifest)
    pending = stage(
        M.pending_files(hash_files(files), manifest, watermark, mode, full_refresh), "pending"
    )
    chosen = pending.count()
    counters = {"files_checked": checked, "files_skipped": checked - chosen}
    if not chosen:
        return counters

    return counters | load_files(house, pending, run_id, at, source_dir)


def load_files(
    house: Warehouse, pending: DataFrame, run_id: str, at: datetime, source_dir: str
) -> dict[str, int]:
    """Audit, read and load the listed files, and tell the manifest what became of each.

    Files that do not conform, or that break while they are read, fail alone.
    """
    begun = M.manifest_entries(pending, run_id, at)
    house.update("file_manifest", schemas.FILE_MANIFEST, lambda held: M.update_manifest(held, begun))
    audit = stage(schema_errors(pending), "audit")
    counts, damaged = write_batch(house, read_audited(house.spark, audit), run_id, at, audit)
    totals = run_totals(counts).first().asDict()

    unread = damaged.withColumnRenamed("error", "_unread")
    verdicts = audit.join(unread, "file_path", "left").select(
        "file_path", F.coalesce("error", "_unread").alias("error")
    )
    entries = stage(M.manifest_entries(pending, run_id, at, verdicts), "entries")
    house.update("file_manifest", schemas.FILE_MANIFEST, lambda held: M.update_manifest(held, entries))
    house.update(
        "manifest_metadata", schemas.MANIFEST_METADATA,
        lambda held: M.advance_watermark(held, entries, source_dir, at),
    )
    files, failed = entries.agg(F.count("*"), F.count_if(F.col("status") == "failed")).first()
    return totals | {
        "files_processed": files, "files_ingested": files - failed, "files_failed": failed,
    }
