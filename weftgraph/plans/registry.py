"""Registered queries: a function of (spark, sf_dir) and, where SQL expresses it, DuckDB SQL of the same result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def put(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return put


def key_sql(*parts: str) -> str:
    """The md5 of parts with their lengths before them, as identity.static_key has it."""
    return "md5(" + " || ".join(f"length('' || {p}) || ':' || {p}" for p in parts) + ")"
