"""Session settings and durable intermediate tables.

Intermediate results that several jobs share are written as parquet tables in
the shared folder named by ``spark.checkpoint.dir``.  A written table survives
the loss of any executor, keeps column pruning and filter pushdown, and gives
the planner its real size, so broadcasts are chosen from measured bytes.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

_SETTINGS = {
    # Every date in the warehouse is a UTC calendar date.
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split oversized join partitions even where that costs the operator above
    # an extra exchange: one account may own a third of all facts.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # A task's share of the input: bounds what its hash maps and sorts hold in memory.
    "spark.sql.files.maxPartitionBytes": "32m",
    # Rows take some ten times their shuffled bytes in a task, and cells of accounts twenty.
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    # Suppliers and parts stay off the shuffle as long as they are smaller than this.
    "spark.sql.autoBroadcastJoinThreshold": "10m",
    # Unlike INT96, this type has statistics that let scans skip row groups.
    "spark.sql.parquet.outputTimestampType": "TIMESTAMP_MICROS",
    "spark.sql.parquet.compression.codec": "zstd",
    # The JVM never compiles a method above 8000 bytes of bytecode; a stage that
    # would need one runs faster as separately generated projections.
    "spark.sql.codegen.hugeMethodLimit": "8000",
    # Rows of a two-valued partition column need no sort before they are written: a task
    # sorts, and spills, what follows the row that opens its last allowed file.
    "spark.sql.maxConcurrentOutputFileWriters": "3",
}

_CHECKPOINT_DIR = "spark.checkpoint.dir"


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings the operators rely on; safe to repeat."""
    for key, value in _SETTINGS.items():
        spark.conf.set(key, value)
    return spark


@contextmanager
def freed_shuffles(spark: SparkSession) -> Iterator[None]:
    """Let shuffle files go as soon as the action that made them ends.

    Else they stay until the driver happens to collect its garbage, and a run of many
    actions holds the files of all.  For blocks that run no DataFrame twice: what a second
    run would read again is made anew, by retries.
    """
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    held = spark.conf.get(name)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.set(name, held)


def bound_batches(spark: SparkSession) -> None:
    """Bound by bytes what goes to Python at once; safe to repeat.

    The bound of ten thousand rows is one of tens of megabytes for texts and sets.  An
    executor and its workers hold a batch several times, and keep part of what they held.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", "2m")


def workspace(spark: SparkSession) -> str:
    """Folder for this application's intermediate tables.

    The cluster's ``spark.checkpoint.dir`` is used where it is set.  Only a
    local session may fall back to a fresh temporary folder.
    """
    root = spark.conf.get(_CHECKPOINT_DIR, None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError(f"set {_CHECKPOINT_DIR} to a folder all executors share")
        root = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_CHECKPOINT_DIR, root)
    return f"{root.rstrip('/')}/ledgerloom-{spark.sparkContext.applicationId}"


_scope: ContextVar[list[str] | None] = ContextVar("scope", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Delete the tables staged inside the block when it ends.

    For runs that end in written tables: an intermediate copy of a batch is as
    large as the batch, and must not outlive the run.
    """
    staged: list[str] = []
    token = _scope.set(staged)
    try:
        yield
    finally:
        _scope.reset(token)
        for location in staged:
            path = spark._jvm.org.apache.hadoop.fs.Path(location)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(
    df: DataFrame, name: str = "stage", partition_by: Sequence[str] = ()
) -> DataFrame:
    """Write ``df`` to a new table in the workspace and return a reader of it."""
    spark = df.sparkSession
    path = f"{workspace(spark)}/{name}-{uuid.uuid4().hex}"
    staged = _scope.get()
    if staged is not None:
        staged.append(path)
    schema = df.schema
    df.write.partitionBy(*partition_by).parquet(path)
    return spark.read.schema(schema).parquet(path).select(*schema.names)
