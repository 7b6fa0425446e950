"""Run registered queries against the same SQL in DuckDB."""

from __future__ import annotations

import datetime as dt
import math
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


# Arrow type of a Spark column -> DuckDB type of the same column.
SAME = {
    "int32": "INTEGER", "int64": "BIGINT", "double": "DOUBLE", "string": "VARCHAR", "bool": "BOOLEAN",
    "date32[day]": "DATE", "timestamp[us]": "TIMESTAMP", "timestamp[us, tz=UTC]": "TIMESTAMP",
}


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, float) and v.is_integer() and abs(v) < 1e15:
        return int(v)
    if isinstance(v, float) and math.isnan(v):
        return "nan"
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if hasattr(v, "as_tuple"):
        f = float(v)
        return int(f) if f.is_integer() else f
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(_plain(r[i]) for i in order) for r in data]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, sf, fn, sql):
    """(ok, message, spark seconds, sql seconds)"""
    t0 = time.time()
    df = fn(spark, sf)
    table = df.toArrow()
    got = rows(df.columns, [tuple(r.values()) for r in table.to_pylist()])
    t1 = time.time()
    cur = con.execute(sql)
    want = rows([d[0] for d in cur.description], cur.fetchall())
    t2 = time.time()
    types = {f.name: str(f.type) for f in table.schema}
    sql_types = {d[0]: str(d[1]) for d in cur.description}
    if got[0] != want[0]:
        return False, f"columns {got[0]} != {want[0]}", t1 - t0, t2 - t1
    if len(got[1]) != len(want[1]):
        msg = f"{len(got[1])} rows != {len(want[1])}"
        return False, msg + _diff(got, want), t1 - t0, t2 - t1
    if got[1] != want[1]:
        return False, _diff(got, want), t1 - t0, t2 - t1
    gaps = {c: (t, sql_types[c]) for c, t in types.items() if SAME.get(t) != sql_types[c]}
    return True, f"{len(got[1])} rows {gaps or ''}", t1 - t0, t2 - t1


def _diff(got, want):
    a, b = set(map(repr, got[1])), set(map(repr, want[1]))
    return f" {got[0]} only spark: {sorted(a - b)[:3]} only sql: {sorted(b - a)[:3]}"
