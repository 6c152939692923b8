"""Runs registered queries against their SQL in DuckDB."""

from __future__ import annotations

import glob
import os

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        files = sorted(glob.glob(f"{path}/*.parquet")) if os.path.isdir(path) else [path]
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet({files!r})")
    return con


def canonical(df: pd.DataFrame) -> list[tuple]:
    df = df[sorted(df.columns)]
    return sorted((tuple(_cell(v) for v in row) for row in df.itertuples(index=False)), key=repr)


def _cell(v):
    if isinstance(v, (list, tuple)) or hasattr(v, "tolist") and getattr(v, "ndim", 0):
        return tuple(_cell(x) for x in list(v))
    if v is None or v is pd.NA or v is pd.NaT or isinstance(v, float) and v != v:
        return None
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        return int(v) if v == int(v) else round(v, 6)
    return str(v) if not isinstance(v, (int, str)) else v


def compare(spark, folder: str, query, sql: str, con=None) -> str:
    """Empty if the results agree, else what differs first."""
    got, want = query(spark, folder).toPandas(), (con or connect(folder)).execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} and {sorted(want.columns)}"
    a, b = canonical(got), canonical(want)
    if len(a) != len(b):
        return f"{len(a)} and {len(b)} rows"
    return next((f"{x} and {y}" for x, y in zip(a, b) if x != y), "")
