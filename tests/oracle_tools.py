"""Comparing a query's rows with its SQL in DuckDB, regardless of row and column order."""

from __future__ import annotations

import os

import duckdb
import pandas as pd

from tideline.sources.tables import TABLES

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def connect(sf_dir: str = SF_DIR) -> duckdb.DuckDBPyConnection:
    db = duckdb.connect()
    for t in TABLES:
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return db


def plain(v):
    if v is None or v is pd.NaT:
        return None
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6) + 0.0
    if hasattr(v, "isoformat"):
        return str(pd.Timestamp(v))
    return v


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def same(spark, name: str, query, sql: str, sf_dir: str = SF_DIR) -> int:
    df = query(spark, sf_dir)
    found = connect(sf_dir).sql(sql)
    assert sorted(df.columns) == sorted(found.columns), name
    got, expected = rows_of(df.columns, df.collect()), rows_of(found.columns, found.fetchall())
    assert got == expected, name
    return len(got)
