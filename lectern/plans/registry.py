"""Name -> query and SQL oracle of every operator of the library."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lectern.sources.adapters import with_ctes

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, *adapters: str) -> Callable[[Query], Query]:
    """Register a query under its function's name, with its oracle over the named adapters."""

    def put(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_ctes(sql, *adapters) if adapters else sql
        return f

    return put
