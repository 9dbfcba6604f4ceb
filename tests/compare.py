"""Comparing a frame with DuckDB on the same tables."""

import math
import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def norm(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else f"{value:.9g}"
    return [norm(x) for x in value] if isinstance(value, (list, tuple)) else str(value)


def rows_of(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    return sorted(str([norm(r[i]) for i in order]) for r in rows)


def same(df, sql, sf):
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf}/{name}.parquet"
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    other = con.sql(sql)
    assert sorted(df.columns) == sorted(other.columns)
    assert rows_of(df.columns, df.collect()) == rows_of(other.columns, other.fetchall())
