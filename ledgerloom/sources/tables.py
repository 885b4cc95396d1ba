"""Table sinks: appends, replaced snapshots, views, exports and readers."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.files import child_names, delete, exists, read_text, write_once

#: Folder of the files that name what a version of a table consists of.
_LOG = "_log"
#: The part of a table that has one part only.
_ROWS = "rows"
#: Versions of a table that stay readable.
KEPT = 16
#: Quoted and unchanged in both directions, with line breaks inside values.
_CSV = {
    "header": True,
    "multiLine": True,
    "quote": '"',
    "escape": '"',
    "ignoreLeadingWhiteSpace": False,
    "ignoreTrailingWhiteSpace": False,
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
#: A CSV file with line breaks in values cannot be split, so files stay small.
_CSV_ROWS = 1_000_000


#: Shuffled bytes of rows that go to one file of a partition value.
_FILE_BYTES = "32m"


@contextmanager
def _large_files(spark: SparkSession) -> Iterator[None]:
    """Let REBALANCE gather more rows in a task than other steps do, while a table is written."""
    name = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    held = spark.conf.get(name)
    spark.conf.set(name, _FILE_BYTES)
    try:
        yield
    finally:
        spark.conf.set(name, held)


def append_partitioned(
    df: DataFrame, path: str, by: str, sort: Sequence[str] = (),
    add: Callable[[DataFrame], DataFrame] = lambda rows: rows,
) -> None:
    """Add rows to a partitioned parquet table.

    REBALANCE gathers each partition value into few files of ``_FILE_BYTES``;
    adaptive execution splits a value that holds far more rows than the
    others, so one hot value is still written by many tasks.  ``add`` adds to the
    rows where they are written.
    """
    balanced = add(df.hint("rebalance", F.col(by))).sortWithinPartitions(by, *sort)
    with _large_files(df.sparkSession):
        balanced.write.mode("append").partitionBy(by).parquet(path)


def replace_partitions(df: DataFrame, path: str, by: str) -> None:
    """Write rows as they are distributed, replacing the partitions they belong to."""
    writer = df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(by).parquet(path)


def read_partitioned(
    spark: SparkSession, path: str, schema: T.StructType, extra: T.StructType | None = None
) -> DataFrame:
    """Read an appended table; before the first append it is empty.

    ``extra`` names partition columns that are not columns of the table.
    """
    shape = T.StructType(schema.fields + (extra.fields if extra else []))
    if not exists(spark, path):
        return spark.createDataFrame([], shape)
    return spark.read.schema(shape).parquet(path).select(*shape.names)


@dataclass(frozen=True)
class Version:
    """What a published table consists of: folders of rows, by part, and notes."""

    number: int = 0
    parts: dict[str, list[str]] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)

    def folders(self, part: str = _ROWS) -> list[str]:
        return self.parts.get(part, [])


def _log_path(root: str, number: int) -> str:
    return f"{root}/{_LOG}/{number:010d}"


def _numbers(spark: SparkSession, root: str) -> list[int]:
    names = child_names(spark, f"{root}/{_LOG}")
    return sorted(int(name) for name in names if name.isdigit())


def read_version(spark: SparkSession, root: str, number: int) -> Version:
    held = json.loads(read_text(spark, _log_path(root, number)))
    return Version(number, held["parts"], held["notes"])


def head(spark: SparkSession, root: str) -> Version | None:
    """The last committed version, or None before the first."""
    numbers = _numbers(spark, root)
    return read_version(spark, root, numbers[-1]) if numbers else None


def commit(spark: SparkSession, root: str, version: Version) -> bool:
    """Make a version the table, unless another writer has taken its number.

    A version is one small file that names the folders it consists of.  It appears at
    once or not at all, and its number can be taken only once, so a writer that lost
    must read the table again: no version replaces one its writer has not seen.
    """
    text = json.dumps({"parts": version.parts, "notes": version.notes}, sort_keys=True)
    return write_once(spark, _log_path(root, version.number), text)


def write_part(df: DataFrame, root: str, sort: Sequence[str] = ()) -> str:
    """Write rows into a new folder of a table, which no version names yet."""
    name = f"data/{uuid.uuid4().hex}"
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.parquet(f"{root}/{name}")
    return name


def read_parts(
    spark: SparkSession, root: str, names: Sequence[str], schema: T.StructType
) -> DataFrame:
    if not names:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*(f"{root}/{name}" for name in names))


def publish(df: DataFrame, root: str, sort: Sequence[str] = (), keep: int = KEPT) -> DataFrame:
    """Replace a table as a whole, whatever it was; returns a reader of the rows written.

    A failed write leaves the previous version in place, and a job may read the table
    it replaces.  Of two writers at the same time the later commit is the table, and
    the other's version stays readable before it.
    """
    spark = df.sparkSession
    folder = write_part(df, root, sort)
    while True:
        last = head(spark, root) or Version()
        if commit(spark, root, Version(last.number + 1, {_ROWS: [folder]})):
            break
    expire(spark, root, keep)
    return read_parts(spark, root, [folder], df.schema)


def update(
    spark: SparkSession,
    root: str,
    schema: T.StructType,
    change: Callable[[DataFrame], DataFrame],
    keep: int = KEPT,
) -> DataFrame:
    """Replace a table by what ``change`` makes of it, losing no other writer's change.

    If another version was committed meanwhile, the change is made again on that one.
    """
    while True:
        last = head(spark, root) or Version()
        folder = write_part(change(read_parts(spark, root, last.folders(), schema)), root)
        if commit(spark, root, Version(last.number + 1, {_ROWS: [folder]})):
            expire(spark, root, keep)
            return read_parts(spark, root, [folder], schema)
        delete(spark, f"{root}/{folder}")


def expire(spark: SparkSession, root: str, keep: int) -> None:
    """Forget all but the last ``keep`` versions, with the folders that only they name.

    Folders that no version has named yet belong to writers at work and stay.
    """
    numbers = _numbers(spark, root)
    old, kept = numbers[:-keep], numbers[-keep:]
    if not old:
        return
    used = {n for v in kept for names in read_version(spark, root, v).parts.values() for n in names}
    for number in old:
        try:
            parts = read_version(spark, root, number).parts
        except Exception:
            if number in _numbers(spark, root):
                raise
            continue  # another writer has just expired it
        for name in {n for names in parts.values() for n in names} - used:
            delete(spark, f"{root}/{name}")
        delete(spark, _log_path(root, number))


def has_version(spark: SparkSession, root: str) -> bool:
    return bool(_numbers(spark, root))


def latest(spark: SparkSession, root: str, schema: T.StructType) -> DataFrame:
    """The last committed version of a published table, or no rows.

    Rows of which no version is committed are an error: an empty table in their
    place would lose what was there.
    """
    version = head(spark, root)
    if version is None and child_names(spark, f"{root}/data"):
        raise RuntimeError(f"{root} has rows, but no version of it is committed")
    names = [n for group in version.parts.values() for n in group] if version else []
    return read_parts(spark, root, names, schema)


def replace_table(df: DataFrame, name: str, sort: Sequence[str] = ()) -> DataFrame:
    """Create or replace a catalog table."""
    out = df.sortWithinPartitions(*sort) if sort else df
    out.write.mode("overwrite").saveAsTable(name)
    return df.sparkSession.table(name)


def replace_view(df: DataFrame, name: str) -> DataFrame:
    """Create or replace a lazily evaluated view."""
    df.createOrReplaceTempView(name)
    return df.sparkSession.table(name)


def read_table(spark: SparkSession, name: str) -> DataFrame:
    """Every column and row of a catalog table or view."""
    return spark.table(name)


def export(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write a table as parquet or as CSV with a header.

    Text is quoted, so line breaks, quotes, blanks and empty text come back as they
    were; a reader cannot split such a file, hence the bound on rows a file.
    """
    if fmt not in ("parquet", "csv"):
        raise ValueError(f"unknown export format: {fmt}")
    writer = df.write.mode("error").format(fmt)
    if fmt == "csv":
        writer = writer.options(**_CSV, quoteAll=True, emptyValue='""', nullValue=None)
        writer = writer.option("maxRecordsPerFile", _CSV_ROWS)
    writer.save(path)


def read_export(spark: SparkSession, path: str, fmt: str, schema: T.StructType) -> DataFrame:
    """Read an export back with its declared schema."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.options(**_CSV)
    return reader.load(path)
