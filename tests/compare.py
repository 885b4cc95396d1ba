"""Compare registered queries with their SQL on DuckDB."""

from __future__ import annotations

import datetime as dt
import math
from collections import Counter
from pathlib import Path

import duckdb


def sql_connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def _bag(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(row[i]) for i in order) for row in rows)


def difference(df, con, sql: str) -> str | None:
    """A description of the first difference, or None for equal results."""
    found = con.execute(sql)
    sql_columns = [d[0] for d in found.description]
    sql_rows = found.fetchall()
    rows = [tuple(row) for row in df.collect()]
    if sorted(df.columns) != sorted(sql_columns):
        return f"columns {sorted(df.columns)} != {sorted(sql_columns)}"
    ours, theirs = _bag(df.columns, rows), _bag(sql_columns, sql_rows)
    if ours != theirs:
        return (f"{len(rows)} rows vs {len(sql_rows)}; only here {list((ours - theirs).items())[:2]}; "
                f"only there {list((theirs - ours).items())[:2]}")
    return None
