"""The list of registered queries: a Spark plan and, where possible, its SQL twin."""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from parcelmill.plans.bindings import Tables, duckdb_sql

_RUN: dict[str, Callable[[Tables], DataFrame]] = {}
_SQL: dict[str, str] = {}
_MODULES = (
    "cleaning", "filtering", "joining", "aggregating", "windowing", "writing",
    "spatial", "documents", "ratios", "modeling", "comparables", "feeds", "quality", "pages",
)


def query(name: str, sql: str | None = None):
    """Register a plan under `name`; `sql` is checked against it in DuckDB."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in _RUN:
            raise ValueError(f"query {name} registered twice")
        _RUN[name] = fn
        if sql is not None:
            _SQL[name] = duckdb_sql(sql)
        return fn

    return wrap


def _load() -> None:
    for module in _MODULES:
        if importlib.util.find_spec(f"parcelmill.plans.{module}") is None:
            continue
        importlib.import_module(f"parcelmill.plans.{module}")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()

    def bind(fn: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        return lambda spark, folder: fn(Tables(spark, folder))

    return {name: bind(fn) for name, fn in _RUN.items()}


def all_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)
