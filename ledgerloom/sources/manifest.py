"""Incremental file selection: which files are new, and what became of each."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom import schemas


MODES = ("hash", "stat", "watermark")


def changed_files(files: DataFrame, manifest: DataFrame) -> DataFrame:
    """Drop files that were read with success and still have that size and time.

    This saves hashing a landing directory again on every run.
    """
    same = ["file_path", "file_size_bytes", "file_mtime"]
    done = manifest.where(F.col("status") == "success").select(*same)
    return files.join(done, same, "left_anti")


def pending_files(
    files: DataFrame,
    manifest: DataFrame,
    watermark: float | None = None,
    mode: str = "hash",
    full_refresh: bool = False,
) -> DataFrame:
    """Hashed files still to be read.

    ``mode="hash"`` skips a file only if the same content was read with
    success before.  ``mode="stat"`` does so too, but the caller may have dropped
    files of unchanged size and time (``changed_files``) before hashing them, which
    is cheaper and misses content replaced without a trace.  ``mode="watermark"`` first skips every file whose time is
    not above the watermark, which is cheaper but never sees a late, changed
    or once failed file with an old time.  A full refresh reads everything.
    """
    if mode not in MODES:
        raise ValueError(f"unknown mode: {mode}")
    if full_refresh:
        return files
    if mode == "watermark" and watermark is not None:
        files = files.where(F.col("file_mtime") > F.lit(watermark))
    done = manifest.where(F.col("status") == "success").select("file_path", "file_hash")
    return files.join(done, ["file_path", "file_hash"], "left_anti")


def manifest_entries(
    files: DataFrame, run_id: str, at: datetime, errors: DataFrame | None = None
) -> DataFrame:
    """Manifest rows for listed files: pending, or finished once ``errors`` is known.

    ``errors`` holds (file_path, error); a file with an error has failed and
    every other file has succeeded.
    """
    rows = files.select(
        "file_path", "file_size_bytes", "file_hash", "file_mtime",
        F.lit(run_id).alias("run_id"), F.lit(at).alias("processed_at"),
    )
    if errors is None:
        rows = rows.select("*", F.lit("pending").alias("status"),
                           F.lit(None).cast("string").alias("error_message"))
    else:
        rows = rows.join(errors.select("file_path", "error"), "file_path", "left").select(
            *rows.columns,
            F.when(F.col("error").isNull(), "success").otherwise("failed").alias("status"),
            F.col("error").alias("error_message"),
        )
    return rows.select(*schemas.FILE_MANIFEST.names)


def update_manifest(manifest: DataFrame, entries: DataFrame) -> DataFrame:
    """Upsert by file path: a new entry replaces the old one, error text included."""
    kept = manifest.join(entries.select("file_path"), "file_path", "left_anti")
    return kept.select(*manifest.columns).unionByName(entries.select(*manifest.columns))


def reset_manifest(manifest: DataFrame, run_id: str, at: datetime) -> DataFrame:
    """Full refresh: keep every entry, but mark it pending for this run."""
    return manifest.withColumns({
        "status": F.lit("pending"),
        "run_id": F.lit(run_id),
        "error_message": F.lit(None).cast("string"),
        "processed_at": F.lit(at),
    })


def advance_watermark(
    metadata: DataFrame, entries: DataFrame, source_dir: str, at: datetime
) -> DataFrame:
    """Set the directory's watermark to the newest file read with success.

    It is set, not raised: a full refresh may move it down.  Without any
    success the metadata stays as it was.
    """
    newest = (
        entries.where(F.col("status") == "success")
        .agg(F.max("file_mtime").alias("watermark_mtime"))
        .where(F.col("watermark_mtime").isNotNull())
        .select(F.lit(source_dir).alias("source_dir"), "watermark_mtime",
                F.lit(at).alias("updated_at"))
    )
    kept = metadata.join(newest.select("source_dir"), "source_dir", "left_anti")
    return kept.select(*metadata.columns).unionByName(newest.select(*metadata.columns))


def drop_watermark(metadata: DataFrame, source_dir: str) -> DataFrame:
    return metadata.where(F.col("source_dir") != source_dir)


def read_watermark(metadata: DataFrame, source_dir: str) -> float | None:
    """The directory's watermark, or None before the first success."""
    row = metadata.where(F.col("source_dir") == source_dir).select("watermark_mtime").first()
    return row.watermark_mtime if row else None
