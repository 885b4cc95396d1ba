"""Thin helpers over Spark's Hadoop file system and, on executors, Arrow's."""

from __future__ import annotations

import os
import uuid
from typing import Any

from pyspark.sql import SparkSession


def _resolve(spark: SparkSession, location: str) -> tuple[Any, Any]:
    path = spark._jvm.org.apache.hadoop.fs.Path(location)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def exists(spark: SparkSession, location: str) -> bool:
    fs, path = _resolve(spark, location)
    return fs.exists(path)


def qualified(spark: SparkSession, location: str) -> str:
    """The location as listings have it: with scheme, and without a last slash."""
    fs, path = _resolve(spark, location)
    return fs.makeQualified(path).toString()


def touch(spark: SparkSession, location: str) -> None:
    """Create an empty file."""
    fs, path = _resolve(spark, location)
    fs.create(path, True).close()


def write_once(spark: SparkSession, location: str, text: str) -> bool:
    """Create a file with its text at once, or say that it is there already.

    Of two writers exactly one wins: the text is written aside and moved into place
    by an operation that fails if the place is taken (a link on a local disk, a rename
    elsewhere).  HDFS and ABFS rename so in one step; a plain object store does not,
    and needs a file system over it that does.
    """
    fs, path = _resolve(spark, location)
    aside = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"_aside-{uuid.uuid4().hex}")
    fs.mkdirs(path.getParent())
    stream = fs.create(aside, False)
    stream.write(bytearray(text.encode()))
    stream.close()
    try:
        if fs.getScheme() != "file":
            return fs.rename(aside, path)
        os.link(aside.toUri().getPath(), path.toUri().getPath())
        return True
    except FileExistsError:
        return False
    finally:
        fs.delete(aside, False)


def read_text(spark: SparkSession, location: str) -> str:
    fs, path = _resolve(spark, location)
    stream = fs.open(path)
    try:
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
    finally:
        stream.close()


def delete(spark: SparkSession, location: str) -> None:
    """Remove a file or a folder with all it holds; nothing there is no error."""
    fs, path = _resolve(spark, location)
    fs.delete(path, True)


def child_names(spark: SparkSession, location: str) -> list[str]:
    fs, path = _resolve(spark, location)
    return [item.getPath().getName() for item in fs.listStatus(path)] if fs.exists(path) else []


def open_input(location: str) -> Any:
    """Open a file for random reads from a task, whatever store it is in."""
    from pyarrow import fs as arrow_fs

    scheme, _, rest = location.partition(":")
    if scheme == "file":
        return arrow_fs.LocalFileSystem().open_input_file("/" + rest.lstrip("/"))
    uri = location.replace("s3a://", "s3://", 1).replace("abfss://", "abfs://", 1)
    store, path = arrow_fs.FileSystem.from_uri(uri)
    return store.open_input_file(path)
