"""Comparing a Spark query with its oracle SQL on DuckDB."""

from __future__ import annotations

import datetime
import decimal
import os
from collections import Counter

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, decimal.Decimal):
        return float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, float) and value == 0:
        return 0.0
    return value


def _kind(value):
    return "int" if isinstance(value, int) and not isinstance(value, bool) else type(value).__name__


def spark_rows(df):
    names = sorted(df.columns)
    return names, [tuple(_plain(row[n]) for n in names) for row in df.select(*[f"`{n}`" for n in names]).collect()]


def oracle_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, [tuple(_plain(row[i]) for i in order) for row in result.fetchall()]


def compare(df, con, sql):
    """None if equal, else what differs. Types are compared by kind (int, float, ..)."""
    names, ours = spark_rows(df)
    expected_names, theirs = oracle_rows(con, sql)
    if names != expected_names:
        return f"columns {names} != {expected_names}"
    if len(ours) != len(theirs):
        return f"{len(ours)} rows, expected {len(theirs)}"
    a, b = (Counter((v, *map(_kind, v)) for v in rows) for rows in (ours, theirs))
    if a != b:
        extra, missing = list((a - b).elements())[:3], list((b - a).elements())[:3]
        return f"columns {names}: extra {extra}, missing {missing} ({sum((a - b).values())} rows)"
    return None
