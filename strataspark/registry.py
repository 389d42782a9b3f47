"""Every registered query with its oracle: operator id -> (callable, DuckDB SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Decorator: add a query under its operator id, with the SQL that must give the same rows."""

    def add(f: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = f
        if sql:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    """Import the modules that register queries."""
    import importlib
    import pkgutil

    from strataspark import functions, operators, sources, streaming

    for package in (operators, functions, sources, streaming):
        for m in pkgutil.iter_modules(package.__path__):
            importlib.import_module(f"{package.__name__}.{m.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
