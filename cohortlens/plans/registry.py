"""Registered queries and the SQL that equals them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

#: Digits that results keep, as engines add up in different orders.
DIGITS = 6


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query; sql may name {PRED}, {ORDERS}, {DAYS}, {PEOPLE} for the adapters."""

    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = with_adapters(sql)
        return f

    return add


def with_adapters(sql: str) -> str:
    for name, text in (("PRED", adapters.PREDICTIONS), ("ORDERS", adapters.ORDERS), ("DAYS", adapters.USER_DAYS), ("PEOPLE", adapters.PEOPLE)):
        sql = sql.replace("{" + name + "}", f"({adapters.fill(text)})")
    return sql


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Doubles to DIGITS digits; -0.0 becomes 0.0."""
    names = columns or [n for n, t in df.dtypes if t == "double"]
    return df.withColumns({c: F.round(F.col(c), DIGITS) + F.lit(0.0) for c in names})
