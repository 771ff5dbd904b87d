"""Registry of queries: each pairs a DataFrame plan with the SQL that must return the same rows."""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

#: Modules that register their queries on import.
MODULES: tuple[str, ...] = ("quarry.plans.core", "quarry.plans.analytics", "quarry.plans.structure", "quarry.plans.ranking", "quarry.plans.graphs", "quarry.plans.items", "quarry.plans.texts", "quarry.plans.statistics", "quarry.plans.files", "quarry.plans.writes", "quarry.plans.usage", "quarry.plans.cascades", "quarry.plans.scalars")


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query and, where SQL can express it, its SQL."""

    def register(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return register


def _load() -> None:
    for module in MODULES:
        import_module(module)


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
