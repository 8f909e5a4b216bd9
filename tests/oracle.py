"""Run queries in Spark and their SQL in DuckDB, and compare the rows."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb
from veilwright.sources.tables import TABLES


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else repr(value)
    if isinstance(value, decimal.Decimal):
        return repr(float(value))
    if isinstance(value, bool):
        return value
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, (list, tuple)):
        return tuple(cell(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, cell(v)) for k, v in value.items()))
    return value


def compare(df, con, sql: str) -> tuple[str, int, int]:
    """Empty text when equal, else what differs; and both row counts."""
    result = con.execute(sql)
    theirs_names = [d[0] for d in result.description]
    theirs = result.fetchall()
    ours = df.collect()
    if sorted(df.columns) != sorted(theirs_names):
        return f"columns {sorted(df.columns)} against {sorted(theirs_names)}", len(ours), len(theirs)
    order = sorted(df.columns)
    a = sorted(repr(tuple(cell(r[c]) for c in order)) for r in ours)
    b = sorted(repr(tuple(cell(r[theirs_names.index(c)]) for c in order)) for r in theirs)
    if a == b:
        return "", len(a), len(b)
    sa, sb = set(a), set(b)
    only_a = [x for x in a if x not in sb][:2]
    only_b = [x for x in b if x not in sa][:2]
    return f"only spark {only_a} only sql {only_b}", len(a), len(b)
