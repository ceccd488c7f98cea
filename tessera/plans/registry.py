"""Registry of named queries over the driver tables, each with its SQL twin.

A query is a callable ``(spark, sf_dir) -> DataFrame``. The SQL twin is an
ANSI query over the same tables (DuckDB dialect) used as the correctness
oracle; operators whose result is not expressible in SQL register none.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, QueryFn] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    """Decorator: register ``fn`` under ``name`` with an optional oracle SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in _QUERIES:
            raise ValueError(f"query {name!r} registered twice")
        _QUERIES[name] = fn
        if sql is not None:
            _SQL[name] = sql
        return fn

    return deco


def _load_all() -> None:
    # Import for the registration side effect.
    from tessera.plans import (  # noqa: F401
        q_prepare,
        q_sources,
        q_resolve,
        q_quality,
        q_select,
        q_post,
        q_diagnostics,
        q_density,
        q_export,
        q_models,
    )


def all_queries() -> dict[str, QueryFn]:
    _load_all()
    return dict(_QUERIES)


def all_sql() -> dict[str, str]:
    _load_all()
    return dict(_SQL)
