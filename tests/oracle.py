"""Run a registered query on Spark and its statement on DuckDB, and compare the rows."""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os

import duckdb

DATA = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.01")
TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
    "pages", "benchmark", "labels", "conversations",
]


def connect(sf_dir: str = DATA):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return float(f"{v:.12g}")
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, dt.date):
        return v.isoformat()
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [cols[i] for i in order], sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def kinds(rows, n):
    out = []
    for i in range(n):
        seen = {type(r[i]).__name__ for r in rows if r[i] is not None}
        out.append(seen)
    return out


def compare(spark, con, query, sql, sf_dir: str = DATA):
    """None if equal, else a short description of the first difference."""
    df = query(spark, sf_dir)
    got_cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want_cols, want = rows_of(names, cur.fetchall())
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}; spark {got[:2]} duckdb {want[:2]}"
    for g, w in zip(got, want):
        if g != w:
            return f"{got_cols}\n spark {g}\n duck  {w}"
    for c, a, b in zip(got_cols, kinds(got, len(got_cols)), kinds(want, len(got_cols))):
        if a != b:
            return f"type of {c}: {a} != {b}"
    if not got:
        return "both empty"
    return None
