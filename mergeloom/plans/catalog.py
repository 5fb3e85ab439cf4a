"""Named queries over the driver tables, each with its SQL where it has one.

A query applies operators of this package; the SQL says the same independently.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function under its own name, with its SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return register


def load() -> tuple[dict[str, Query], dict[str, str]]:
    from mergeloom.plans import queries_aggregate, queries_keyed, queries_monoid, queries_sketch, queries_value  # noqa: F401

    return QUERIES, ORACLE
