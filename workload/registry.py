"""Registry of queries with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(*ctes: str, select: str | None = None, recursive: bool = False) -> Callable[[Query], Query]:
    """Register a function under its own name, with the SQL made of the parts."""

    def register(function: Query) -> Query:
        QUERIES[function.__name__] = function
        if select is not None:
            start = "WITH RECURSIVE " if recursive else "WITH "
            ORACLES[function.__name__] = (start + ",".join(ctes) + "\n" if ctes else "") + select
        return function

    return register
