"""Queries over the files of the given tables, where some tables are folders of parts."""

from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry
from compare import difference

SF_DIR = "/root/testdata/sf0.001"
IN_PARTS = ("documents", "labels")


@pytest.fixture(scope="module")
def parts(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("parts")
    for path in Path(SF_DIR).glob("*.parquet"):
        if path.stem in IN_PARTS:
            spark.read.parquet(str(path)).repartition(2).write.parquet(str(folder / path.name))
        else:
            (folder / path.name).write_bytes(path.read_bytes())
    return folder


@pytest.mark.parametrize("name", ["landing_listing", "manifest_pending", "schema_audit"])
def test_tables_in_parts_are_listed_whole(spark, parts, name):
    con = duckdb.connect()
    for path in parts.glob("*.parquet"):
        files = f"{path}/*.parquet" if path.is_dir() else str(path)
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{files}')")
    assert difference(entry.queries()[name](spark, str(parts)), con, entry.oracle_sql()[name]) is None
