"""Compares a query with its DuckDB oracle: columns, and values as multisets."""

from __future__ import annotations

import os
from collections import Counter

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        con.sql(f"create view {t} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    found = con.sql(sql)
    columns = sorted(found.columns)
    assert columns == sorted(df.columns)
    where = [found.columns.index(c) for c in columns]
    want = Counter(tuple(repr(r[i]) for i in where) for r in found.fetchall())
    got = Counter(tuple(repr(r[c]) for c in columns) for r in df.collect())
    assert got == want, (list((got - want).items())[:3], list((want - got).items())[:3])
