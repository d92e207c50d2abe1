"""Registered queries against their SQL in DuckDB."""

from __future__ import annotations

import glob
import math
import os

import duckdb


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return con


def _plain(x):
    return "nan" if isinstance(x, float) and math.isnan(x) else x


def rows_of(columns: list[str], rows) -> list[tuple]:
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(_plain(r[i]) for i in order) for r in rows), key=repr)


def assert_same(df, con, sql: str) -> int:
    want = con.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    got = rows_of(df.columns, df.collect())
    expected = rows_of(names, want.fetchall())
    assert len(got) == len(expected), f"{len(got)} rows, not {len(expected)}"
    assert got == expected, next((g, e) for g, e in zip(got, expected) if g != e)
    return len(got)
