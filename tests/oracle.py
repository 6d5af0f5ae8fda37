"""Runs a query and its SQL on the same tables and compares whole results."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb
from pyspark.sql import SparkSession


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM read_parquet('{f}')")
    return con


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else float(f"{x:.10g}")
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, dict):
        return tuple(sorted((k, plain(v)) for k, v in x.items()))
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if hasattr(x, "asDict"):
        return plain(x.asDict())
    return x


def table(names, rows):
    order = sorted(range(len(names)), key=lambda k: names[k])
    return [names[k] for k in order], sorted((tuple(plain(r[k]) for k in order) for r in rows), key=repr)


def compare(spark: SparkSession, plan, sql: str, folder: str, con=None) -> str:
    """Empty if equal, else what differs."""
    found = plan(spark, folder)
    ours = table(found.columns, found.collect())
    cursor = (con or connect(folder)).execute(sql)
    theirs = table([c[0] for c in cursor.description], cursor.fetchall())
    if ours[0] != theirs[0]:
        return f"columns {ours[0]} and {theirs[0]}"
    if ours[1] != theirs[1]:
        lost, extra = [r for r in theirs[1] if r not in set(ours[1])][:2], [r for r in ours[1] if r not in set(theirs[1])][:2]
        return f"{len(ours[1])} and {len(theirs[1])} rows; ours {extra}; SQL {lost}"
    return ""
