"""Comparing a Spark result with DuckDB on the same parquet files."""

from __future__ import annotations

import datetime
import decimal
import glob
import os

import duckdb


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in sorted(glob.glob(f"{sf_dir}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 9)
    if isinstance(value, decimal.Decimal):
        return int(value) if value == value.to_integral_value() else float(value)
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return value


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    key = lambda r: tuple((v is not None, type(v).__name__, v) for v in r)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=key)


def difference(spark_df, con, sql: str) -> str | None:
    """None when both results agree, else what differs."""
    mine = spark_df.collect()
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    theirs = cursor.fetchall()
    if sorted(spark_df.columns) != sorted(names):
        return f"columns {sorted(spark_df.columns)} / {sorted(names)}"
    a, b = rows_of(spark_df.columns, mine), rows_of(names, theirs)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            bad = [(n, p, q) for n, p, q in zip(sorted(names), x, y) if p != q]
            return f"values {bad[:3]}"
    return None
