"""Run a query and its SQL on the same tables and compare all rows."""

from __future__ import annotations

import os

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{folder}/{t}.parquet"
        if os.path.exists(path):
            con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{path if os.path.isfile(path) else path + '/*.parquet'}'")
    return con


def normal(v):
    if isinstance(v, (list, tuple)):
        return str([normal(x) for x in v])
    return repr(v)


def same(df, con: duckdb.DuckDBPyConnection, sql: str) -> None:
    columns = sorted(df.columns)
    got = sorted(str([normal(r[c]) for c in columns]) for r in df.collect())
    out = con.sql(sql)
    assert sorted(out.columns) == columns
    at = [out.columns.index(c) for c in columns]
    want = sorted(str([normal(r[i]) for i in at]) for r in out.fetchall())
    assert got == want
