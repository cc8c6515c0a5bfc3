"""Compares a query with its SQL in DuckDB."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

SF = "/root/testdata/sf0.001"


def rows(df: pd.DataFrame) -> list[str]:
    def plain(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return f"{v:.9g}"
        return str(list(map(str, v))) if hasattr(v, "__iter__") and not isinstance(v, (str, bytes, dict)) else str(v)

    ordered = df[sorted(df.columns)].astype(object)
    return sorted(repr(tuple(map(plain, r))) for r in ordered.itertuples(index=False))


def duck(sql: str, sf: str = SF) -> pd.DataFrame:
    c = duckdb.connect()
    c.execute("SET timezone = 'UTC'")
    for name in os.listdir(sf):
        path = f"{sf}/{name}" + ("/*.parquet" if os.path.isdir(f"{sf}/{name}") else "")
        c.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    return c.execute(sql).df()


def same(spark, query, sql: str, sf: str = SF) -> None:
    ours, theirs = query(spark, sf).toPandas(), duck(sql, sf)
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert rows(ours) == rows(theirs)
