"""Registry of the library's queries and of their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Put a query, and its SQL where SQL can express it, under a name."""

    def add(query: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = query
        if sql is not None:
            _ORACLES[name] = sql
        return query

    return add


def queries() -> dict[str, Query]:
    from lexweave.plans import evidence_queries, queries  # noqa: F401

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from lexweave.plans import evidence_queries, queries  # noqa: F401

    return dict(_ORACLES)
