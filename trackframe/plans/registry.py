"""Registered queries with the DuckDB text that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def r6(x) -> Column:
    """Six decimals, without negative zero, as both engines can compare. The nudge keeps values
    that lie halfway between two results from depending on the last bit of a sum."""
    return F.round((x if isinstance(x, Column) else F.col(x)) + F.lit(1e-9), 6) + F.lit(0.0)


def rounded(df: DataFrame, *keep: str) -> DataFrame:
    """Round every double column but those in keep."""
    return df.select(*[r6(c).alias(c) if t == "double" and c not in keep else F.col(c)
                       for c, t in df.dtypes])
