"""The landing directory: listing, schema audit and reading of parquet files."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom import schemas
from ledgerloom.sources.files import exists, open_input, qualified

_FILES = "file_path string, path string, file_size_bytes long, file_mtime double"
_CHUNK = 4 * 1024 * 1024
_SUMS = "path string, length long, sha string"
#: Bytes of a file that Spark's binary source may give as one value; a task holds several copies.
_WHOLE = 32 * 1024 * 1024

SOURCE_FILE, SOURCE_ROW = "source_file", "_source_row"


def file_contents(spark: SparkSession, directory: str, nested: bool = False) -> DataFrame:
    """Name, size and time of each parquet file; ``content`` is read only if selected."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", "*.parquet")
        .option("recursiveFileLookup", nested)
        .load(directory)
    )


def landing_files(
    spark: SparkSession, directory: str, newer_than: float | None = None, nested: bool = False
) -> DataFrame:
    """List the parquet files of a directory with size and time; no content is read.

    Only files newer than ``newer_than`` (seconds) are listed, if it is given.
    Files in folders of the directory are listed if ``nested``, with the folders in
    their name.  A missing directory gives an empty listing.
    """
    if not exists(spark, directory):
        return spark.createDataFrame([], _FILES)
    files = file_contents(spark, directory, nested)
    if newer_than is not None:
        cut = datetime.fromtimestamp(newer_than, UTC)
        files = files.where(F.col("modificationTime") > F.lit(cut))
    if not nested:
        return listed(files)
    return listed(files, F.substring("path", len(qualified(spark, directory)) + 2, 2**31 - 1))


def listed(files: DataFrame, name: Column | None = None) -> DataFrame:
    """Name, path, size and time of files as Spark's binary source gives them."""
    return files.select(
        (F.element_at(F.split("path", "/"), -1) if name is None else name).alias("file_path"),
        F.col("path"),
        F.col("length").alias("file_size_bytes"),
        F.col("modificationTime").cast("double").alias("file_mtime"),
    )


def _spread(files: DataFrame) -> DataFrame:
    """One slice of the file list per core: a row is small, the file behind it is not."""
    return files.repartition(files.sparkSession.sparkContext.defaultParallelism)


def hash_files(files: DataFrame) -> DataFrame:
    """Add the SHA-256 of each file's bytes, read in chunks, so of any size."""
    columns = ["file_path", "path", "file_size_bytes", "file_mtime"]
    return _spread(files.select(*columns)).mapInPandas(_hash_files, _FILES + ", file_hash string")


def _hash_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        yield files.assign(file_hash=[_sha256(path) for path in files["path"]])


def _sha256(path: str) -> str:
    digest = hashlib.sha256()
    with open_input(path) as source:
        while chunk := source.read(_CHUNK):
            digest.update(chunk)
    return digest.hexdigest()


def file_sums(spark: SparkSession, directory: str, nested: bool = False) -> DataFrame:
    """Length and SHA-256 of each file's bytes, in another way than listing and ``hash_files``.

    Spark's own reader gives a file of up to ``_WHOLE`` bytes as one value.  A value holds
    less than 2 GB, and a task several of its copies, so larger files go through a digest
    of the standard library; their length is the number of bytes that came.
    """
    files = file_contents(spark, directory, nested)
    whole = min(_WHOLE, int(spark.conf.get("spark.sql.sources.binaryFile.maxLength")))
    small = files.where(F.col("length") <= whole).select(
        "path", "length", F.sha2("content", 256).alias("sha")
    )
    large = files.where(F.col("length") > whole).select("path")
    return small.unionByName(_spread(large).mapInPandas(_sum_files, _SUMS))


def _sum_files(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for files in batches:
        rows = []
        for path in files["path"]:
            with open_input(path) as source:
                sha = hashlib.file_digest(source, "sha256").hexdigest()
                rows.append((path, source.tell(), sha))
        yield pd.DataFrame(rows, columns=["path", "length", "sha"])


# --- schema audit -----------------------------------------------------------

_ACCEPTED = {
    "string": ("string",),
    "timestamp": ("timestamp", "timestamp_ns"),
    "double": ("double", "float", "int32", "int64"),
}
_FOOTERS = (
    "file_path string, path string, columns array<string>, kinds array<string>, row_count long, "
    "failure string"
)


def _kind(field_type, stored: str) -> str:
    """A short name for the Arrow types a landing file may use."""
    import pyarrow.types as pt

    if pt.is_string(field_type) or pt.is_large_string(field_type):
        return "string"
    if pt.is_timestamp(field_type):
        # Arrow shows INT96 as nanoseconds, but Spark reads it as a timestamp.
        return "timestamp_ns" if field_type.unit == "ns" and stored != "INT96" else "timestamp"
    return str(field_type)


def _read_footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    import pyarrow as pa
    import pyarrow.parquet as pq

    for files in batches:
        rows = []
        for name, path in zip(files["file_path"], files["path"], strict=True):
            try:
                # A store that cannot be reached raises here, and the run fails.
                with open_input(path) as source:
                    footer = pq.ParquetFile(source)
                    schema, leaves = footer.schema_arrow, footer.schema
                    count = footer.metadata.num_rows
                stored = {leaf.path: leaf.physical_type for leaf in leaves}
                kinds = [_kind(f.type, stored.get(f.name, "")) for f in schema]
                rows.append((name, path, schema.names, kinds, count, None))
            except OSError as failure:
                # Arrow reports a damaged footer without an error number.
                if failure.errno is not None:
                    raise
                rows.append((name, path, [], [], None, str(failure) or type(failure).__name__))
            except pa.ArrowInvalid as failure:  # a broken file is a finding
                rows.append((name, path, [], [], None, str(failure) or type(failure).__name__))
        yield pd.DataFrame(rows, columns=["file_path", "path", "columns", "kinds", "row_count", "failure"]).astype(
            {"row_count": "Int64"})


def _name_list(label: str, names: Column) -> Column:
    """``Label: ['a', 'b']`` for a non-empty array, else NULL."""
    quoted = F.transform(F.array_sort(names), lambda n: F.concat(F.lit("'"), n, F.lit("'")))
    text = F.concat(F.lit(f"{label}: ["), F.array_join(quoted, ", "), F.lit("]"))
    return F.when(F.size(names) > 0, text)


def schema_errors(files: DataFrame, expected=schemas.LANDING) -> DataFrame:
    """Audit the footer of every file against the expected columns and types.

    Column names must match exactly.  Types are judged only when no column is
    missing: any timestamp unit or zone is accepted, and 32- or 64-bit
    integers and floats where a double is expected.  ``error`` is NULL for a
    file that conforms, and ``row_count`` is what its footer says; only footers
    are read.
    """
    footers = _spread(files.select("file_path", "path")).mapInPandas(_read_footers, _FOOTERS)
    names = F.array(*(F.lit(f.name) for f in expected))
    missing = F.array_except(names, "columns")
    extra = F.array_except("columns", names)

    def kind_of(name: str) -> Column:
        return F.get("kinds", F.array_position("columns", F.lit(name)).cast("int") - 1)

    type_errors = [
        F.when(
            (F.size(missing) == 0) & ~kind_of(f.name).isin(*_ACCEPTED[f.dataType.typeName()]),
            F.concat(
                F.lit(f"Column '{f.name}' has type "),
                kind_of(f.name),
                F.lit(f", expected {f.dataType.typeName()}"),
            ),
        )
        for f in expected
    ]
    # The texts of findings, here and above.
    found = F.concat_ws(
        "; ", _name_list("Missing columns", missing), _name_list("Unexpected columns", extra),
        *type_errors,
    )
    error = F.coalesce("failure", F.when(found != "", found))
    return footers.select(
        "file_path",
        "path",
        error.alias("error"),
        kind_of("amount").alias("amount_kind"),
        kind_of("timestamp").alias("timestamp_kind"),
        "row_count",
    )


# --- reading ----------------------------------------------------------------


def conform(df: DataFrame, expected=schemas.LANDING) -> DataFrame:
    """Cast an accepted variant of the landing columns to the declared types."""
    return df.select(
        *(F.col(f.name).cast(f.dataType).alias(f.name) for f in expected),
        *(c for c in df.columns if c not in expected.names),
    )


#: A file that breaks while it is read gives the rows before the break; whoever reads
#: compares their number with the footer's (``damaged_files``).
_READING = {"pathGlobFilter": "*.parquet", "ignoreCorruptFiles": "true"}


def file_name() -> Column:
    """Name of the file a row comes from, as the listing has it (Spark escapes it)."""
    # Decoding a URL would turn a plus into a blank.
    return F.url_decode(F.replace("_metadata.file_name", F.lit("+"), F.lit("%2B")))


def _with_position(reader, paths: list[str]) -> DataFrame:
    raw = reader.options(**_READING).parquet(*paths)
    return raw.select(
        "*",
        file_name().alias(SOURCE_FILE),
        F.col("_metadata.row_index").alias(SOURCE_ROW),
    )


def _no_rows(spark: SparkSession) -> DataFrame:
    position = T.StructType().add(SOURCE_FILE, "string").add(SOURCE_ROW, "long")
    return spark.createDataFrame([], T.StructType(schemas.LANDING.fields + position.fields))


def read_transactions(spark: SparkSession, directory: str) -> DataFrame:
    """Scan a directory of conforming files, with each row's file name and row number."""
    if not exists(spark, directory):
        return _no_rows(spark)
    return _with_position(spark.read.schema(schemas.LANDING), [directory])


def read_audited(spark: SparkSession, audit: DataFrame) -> DataFrame:
    """Read the files an audit accepted, whatever accepted types they store.

    Files are grouped by how they store amount and time (a handful of
    combinations), because one scan has one read schema.  Only file paths
    reach the driver, as they do for any parquet scan.
    """
    groups = (
        audit.where(F.col("error").isNull())
        .groupBy("amount_kind", "timestamp_kind")
        .agg(F.sort_array(F.collect_list("path")).alias("paths"))
        .collect()
    )
    read_as = {"int64": "bigint", "int32": "int", "float": "float", "timestamp_ns": "bigint"}
    scans = []
    for group in groups:
        amount = read_as.get(group.amount_kind, "double")
        instant = read_as.get(group.timestamp_kind, "timestamp")
        shape = ", ".join(
            f"{f.name} {dict(amount=amount, timestamp=instant).get(f.name, 'string')}"
            for f in schemas.LANDING
        )
        scan = _with_position(spark.read.schema(shape), group.paths)
        if instant == "bigint":
            # Integer arithmetic: a double cannot hold nanoseconds since 1970.
            micros = F.expr("(timestamp - pmod(timestamp, 1000)) div 1000")
            scan = scan.withColumn("timestamp", F.timestamp_micros(micros))
        scans.append(conform(scan))
    if not scans:
        return _no_rows(spark)
    first, *rest = scans
    for scan in rest:
        first = first.unionByName(scan)
    return first


def damaged_files(rows: DataFrame, audit: DataFrame) -> DataFrame:
    """Accepted files of which not all rows could be read, with the error to record.

    Spark gives no reason, so the error tells how many rows there were.  A store that
    failed for a moment looks the same; a failed file is read again by the next run.
    """
    read = rows.groupBy(F.col(SOURCE_FILE).alias("file_path")).agg(F.count("*").alias("_read"))
    found = F.coalesce("_read", F.lit(0))
    return (
        audit.where(F.col("error").isNull()).join(read, "file_path", "left")
        .where(found != F.col("row_count"))
        .select("file_path", F.format_string(
            "Damaged file: %d of %d rows could be read", found, F.col("row_count")).alias("error"))
    )
