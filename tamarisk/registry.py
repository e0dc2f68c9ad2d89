"""The library's own queries by name, each with DuckDB SQL where SQL can express it."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

FLAGSHIP = "bm25_topk"
_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its oracle."""

    def put(f: Callable) -> Callable:
        if f.__name__ in _QUERIES:
            raise ValueError(f"two queries are named {f.__name__}")
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return put


def _load() -> None:
    from tamarisk import queries as package

    for m in pkgutil.iter_modules(package.__path__):
        importlib.import_module(f"{package.__name__}.{m.name}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
