"""Compare a registered query with its SQL on DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        name = os.path.basename(path).removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def _plain(value):
    if value is None or value is pd.NaT or (isinstance(value, float) and value != value):
        return None
    if hasattr(value, "item"):
        value = value.item()
    if isinstance(value, bool):
        return value
    if isinstance(value, float):
        return value + 0.0
    return value


def rows(columns, records) -> list[tuple]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(r[i]) for i in order) for r in records]
    return sorted(plain, key=lambda r: tuple((v is not None, str(v)) for v in r))


def difference(spark_df, con, sql: str) -> str | None:
    """None when equal, else a short description."""
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} against {sorted(names)}"
    want = rows(names, result.fetchall())
    have = rows(spark_df.columns, spark_df.collect())
    if len(want) != len(have):
        return f"{len(have)} rows against {len(want)}"
    wrong = [(h, w) for h, w in zip(have, want) if h != w]
    return f"{len(wrong)} rows differ, e.g. {wrong[0][0]} against {wrong[0][1]}" if wrong else None
