"""All queries by name, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a query, and its oracle where SQL can say the same."""

    def put(fn):
        _QUERIES[name] = fn
        if sql:
            _SQL[name] = sql
        return fn

    return put


def _load() -> None:
    from . import fact_queries, ledger_queries, more_queries, search_queries, task_queries  # noqa: F401  they register themselves


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
