"""Run a query on Spark and its SQL on DuckDB and compare the values."""

from __future__ import annotations

import datetime
import glob
import math
import os

import duckdb


def duck(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in sorted(glob.glob(f"{folder}/*.parquet")):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if value is None:
        return "∅"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, float):
        if math.isnan(value):
            return "nan"
        return repr(value + 0.0 if value != 0 else 0.0)
    if isinstance(value, (list, tuple)):
        return "[" + ",".join(plain(v) for v in value) + "]"
    if isinstance(value, (datetime.datetime, datetime.date)):
        return value.isoformat()
    return f"{type(value).__name__}:{value}"


def spark_rows(df):
    names = sorted(df.columns)
    return names, sorted(tuple(plain(row[n]) for n in names) for row in df.collect())


def duck_rows(con, sql):
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    names = sorted(columns)
    order = [columns.index(n) for n in names]
    return names, sorted(tuple(plain(row[i]) for i in order) for row in result.fetchall())


def difference(df, con, sql) -> str | None:
    """None when both sides agree, else a short account of the first gaps."""
    left_names, left = spark_rows(df)
    right_names, right = duck_rows(con, sql)
    if left_names != right_names:
        return f"columns {left_names} != {right_names}"
    if len(left) != len(right):
        return f"rows {len(left)} != {len(right)}; spark {left[:2]} duck {right[:2]}"
    gaps = [(a, b) for a, b in zip(left, right, strict=True) if a != b]
    if gaps:
        return f"{len(gaps)} of {len(left)} rows differ; spark {gaps[0][0]} duck {gaps[0][1]}"
    return None
