"""Comparison of a query with its SQL in DuckDB over the same tables."""

from __future__ import annotations

import glob
import math
import os
from collections import Counter

import duckdb
from pyspark.sql import DataFrame


def connection(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    con.execute("SET memory_limit='8GB'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value: object) -> object:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((k, plain(v)) for k, v in value.items()))
    return value


def rows_of_spark(df: DataFrame) -> Counter:
    names = sorted(df.columns)
    return Counter(tuple(plain(r[n]) for n in names) for r in df.collect())


def difference(con: duckdb.DuckDBPyConnection, df: DataFrame, sql: str) -> str:
    """Empty if both give the same rows under the same names."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    if sorted(names) != sorted(df.columns):
        return f"columns: {sorted(df.columns)} against {sorted(names)}"
    order = [names.index(n) for n in sorted(names)]
    theirs = Counter(tuple(plain(r[i]) for i in order) for r in cur.fetchall())
    mine = rows_of_spark(df)
    if mine == theirs:
        return ""
    return f"{mine.total()} rows against {theirs.total()}; only here {list((mine - theirs).items())[:3]}; only there {list((theirs - mine).items())[:3]}"
