"""All queries of the report engine, with their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

_QUERIES: dict[str, Callable] = {}
_SQL: dict[str, str] = {}
_MODULES = ("scans", "joins", "verification", "sitesadmin", "colors", "measures", "rasters", "kernels", "streams")


def query(name: str, sql: str | None = None):
    """Register ``f(spark, sf_dir)`` as a query, with DuckDB SQL for the same rows where SQL can express it."""

    def add(f):
        _QUERIES[name] = f
        if sql is not None:
            _SQL[name] = sql
        return f

    return add


def _load() -> None:
    for module in _MODULES:
        importlib.import_module(f"muralis.plans.{module}")


def queries() -> dict[str, Callable]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
