"""Query registry: a name, a DataFrame builder and, where the result can be stated in SQL, its twin."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Builder] = {}
ORACLE: dict[str, str] = {}
OPERATORS: dict[str, list[str]] = {}


def query(name: str, operators: str, sql: str | None = None):
    """Register a builder under a name with the operator ids it covers."""
    def keep(fn: Builder) -> Builder:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        OPERATORS[name] = operators.split()
        if sql is not None:
            ORACLE[name] = sql.strip()
        return fn
    return keep
