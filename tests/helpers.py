"""Comparison of query results with SQL run by DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb
import pandas as pd


def canon(v):
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and math.isnan(v):
        return None
    if hasattr(v, "item") and not isinstance(v, (list, tuple)) and getattr(v, "ndim", 0) == 0:
        v = v.item()
    if isinstance(v, (list, tuple)) or getattr(v, "ndim", 0):
        return tuple(canon(x) for x in v)
    if isinstance(v, bool) or isinstance(v, str):
        return v
    return round(float(v), 6) if isinstance(v, (int, float)) or type(v).__name__ == "Decimal" else v


def rows_of(pdf) -> list[str]:
    cols = sorted(pdf.columns)
    return sorted(repr(tuple(map(canon, r))) for r in pdf[cols].astype(object).values.tolist())


def database(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def same(spark, folder: str, query, sql: str, con=None) -> None:
    got = query(spark, folder).toPandas()
    want = (con or database(folder)).execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)
