"""The registry of queries and oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under a name, with its oracle where SQL can express it."""

    def register(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return register


def r6(column: Column | str, name: str | None = None) -> Column:
    """A double rounded to 6 decimals, without negative zeros: sums differ in their last digits from order to order."""
    c = F.col(column) if isinstance(column, str) else column
    return (F.round(c, 6) + 0.0).alias(name or (column if isinstance(column, str) else "value"))
