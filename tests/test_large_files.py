"""Files too large to be one value."""

import hashlib

import pytest

import __spark_entry__ as entry
from compare import difference, sql_connection
from ledgerloom.sources.landing import file_sums

from conftest import rows_of

SF_DIR = "/root/testdata/sf0.001"
LIMIT = "spark.sql.sources.binaryFile.maxLength"


@pytest.fixture
def limited(spark):
    held = spark.conf.get(LIMIT)
    spark.conf.set(LIMIT, "5000")
    yield
    spark.conf.set(LIMIT, held)


def test_files_beyond_the_longest_value_are_listed(spark, limited):
    found = entry.queries()["landing_listing"](spark, SF_DIR)
    assert difference(found, sql_connection(SF_DIR), entry.oracle_sql()["landing_listing"]) is None


def test_sums_are_those_of_the_bytes(spark, tmp_path, limited):
    written = {}
    for name, size in (("one", 1), ("small", 5000), ("large", 5001), ("larger", 700_000)):
        data = bytes(i * i % 251 for i in range(size))
        (tmp_path / f"{name}.parquet").write_bytes(data)
        written[f"{name}.parquet"] = (size, hashlib.sha256(data).hexdigest())
    found = {path.rsplit("/", 1)[1]: sums for path, *sums in rows_of(file_sums(spark, str(tmp_path)))}
    assert {name: tuple(sums) for name, sums in found.items()} == written
