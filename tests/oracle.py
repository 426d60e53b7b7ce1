"""Compare a registered query with its SQL on the driver tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        if math.isnan(value):
            return ("nan",)
        return (1, round(value, 6))
    if isinstance(value, bool):
        return (2, value)
    if isinstance(value, int):
        return (1, round(float(value), 6))
    if value is None:
        return (0,)
    return (3, str(value))


def sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(row[i]) for i in order) for row in rows)


def compare(spark, con, fn, sql, sf_dir):
    """Return (rows, message); the message is empty when both sides agree."""
    df = fn(spark, sf_dir)
    left = [tuple(r) for r in df.collect()]
    result = con.execute(sql)
    columns = [c[0] for c in result.description]
    right = result.fetchall()
    if sorted(df.columns) != sorted(columns):
        return len(left), f"columns {sorted(df.columns)} != {sorted(columns)}"
    a, b = sorted_rows(df.columns, left), sorted_rows(columns, right)
    if len(a) != len(b):
        return len(left), f"rows {len(a)} != {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return len(left), f"columns {sorted(columns)}\n  spark {x}\n  sql   {y}"
    return len(left), ""
