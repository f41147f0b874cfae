"""Spark result against DuckDB result, order-insensitive, columns by name."""

from __future__ import annotations

import datetime
import decimal
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def cell(value):
    if value is None:
        return "~"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, decimal.Decimal):
        value = float(value)
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(int(value)) if value == int(value) and abs(value) < 1e15 else f"{value:.9g}"
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(cell(v) for v in value) + "]"
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def normal(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(cell(r[i]) for i in order) for r in rows)


def diff(columns, rows, con, sql):
    """None when equal, else a short description."""
    duck = con.execute(sql)
    names = [d[0] for d in duck.description]
    want_cols, want = normal(names, duck.fetchall())
    got_cols, got = normal(columns, [tuple(r) for r in rows])
    if got_cols != want_cols:
        return f"columns {got_cols} != {want_cols}"
    if len(got) != len(want):
        extra = list(set(got) - set(want))[:3]
        missing = list(set(want) - set(got))[:3]
        return f"rows {len(got)} != {len(want)}; extra {extra}; missing {missing}"
    bad = [(g, w) for g, w in zip(got, want) if g != w]
    return f"{len(bad)} of {len(got)} differ: {bad[:3]}" if bad else None
