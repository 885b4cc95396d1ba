"""Catalog and manifest queries over every given table, against brute force."""

import json
from pathlib import Path

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from ledgerloom.plans.registry import QUERIES

SF = "/root/testdata/sf0.001"
GIVEN = {p.stem: pq.read_table(p) for p in sorted(Path(SF).glob("*.parquet"))}
DERIVED = {"stg_transactions", "dim_accounts"}


def smallest(column) -> list | None:
    """The three smallest values as text, where Python orders and writes them as Spark does."""
    kind = column.type
    values = [v for v in column.to_pylist() if v is not None]
    if pa.types.is_string(kind) or pa.types.is_large_string(kind):
        return sorted(set(values), key=str.encode)[:3]
    if pa.types.is_integer(kind) or pa.types.is_date(kind):
        return [str(v) for v in sorted(set(values))[:3]]
    if pa.types.is_list(kind):
        return [list(v) for v in sorted(set(map(tuple, values)))[:3]]
    return None


def test_every_column_is_profiled(spark):
    got = {(r.table_name, r.column_name): r for r in QUERIES["column_profile"](spark, SF).collect()}
    want = {(t, c) for t, data in GIVEN.items() for c in data.column_names}
    assert {k for k in got if k[0] not in DERIVED} == want
    assert {k[0] for k in got} == {*GIVEN, *DERIVED}
    compared = set()
    for (table, name), row in got.items():
        if table in DERIVED or (want := smallest(GIVEN[table].column(name))) is None:
            continue
        found = json.loads(row.sample_values) if row.sample_values else []
        if want and isinstance(want[0], list):
            assert [json.loads(v) for v in found] == [pytest.approx(v) for v in want], (table, name)
        else:
            assert found == want, (table, name)
        compared.add(table)
    assert compared == set(GIVEN)


def test_report_and_policy_see_every_table(spark):
    report = {(r.table_name, r.column_name) for r in QUERIES["catalog_columns_report"](spark, SF).collect()}
    assert {t for t, _ in report} == {*GIVEN, *DERIVED}
    found = {(r.table_name, r.column_name) for r in QUERIES["column_name_policy"](spark, SF).collect()}
    assert found <= report
    assert {k for k in report if "name" in k[1]} <= found


def test_every_finding_keeps_its_file_pending(spark):
    got = {r.file_path for r in QUERIES["manifest_pending"](spark, SF).collect()}
    assert got == {f"{t}.parquet" for t in GIVEN}
