"""Comparison of query results with DuckDB's."""

from __future__ import annotations

import glob
import os

import duckdb


def normal(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 6)
    if isinstance(v, list | tuple):
        return tuple(map(normal, v))
    return v


def rows_of(df, columns):
    return sorted(repr(tuple(normal(r[c]) for c in columns)) for r in df.collect())


def sql_rows(sf: str, sql: str):
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    found = con.execute(sql)
    names = [d[0] for d in found.description]
    columns = sorted(names)
    at = [names.index(c) for c in columns]
    return columns, sorted(repr(tuple(normal(r[i]) for i in at)) for r in found.fetchall())


def same(spark, sf, query, sql):
    df = query(spark, sf)
    columns, expected = sql_rows(sf, sql)
    assert sorted(df.columns) == columns
    assert rows_of(df, columns) == expected
