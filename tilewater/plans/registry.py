"""Registry of named queries and their twin SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tilewater.sources.tables import Tables, oracle

_MODULES = (
    "addressing_queries", "value_queries", "text_queries", "generator_queries", "join_queries",
    "raster_queries", "log_queries", "window_queries", "planning_queries", "surface_queries",
    "geometry_queries", "stream_queries", "file_queries",
)


@dataclass(frozen=True)
class Query:
    key: str
    run: Callable[[Tables], DataFrame]
    sql: str | None


_QUERIES: dict[str, Query] = {}


def query(key: str, views: str = "", sql: str | None = None):
    """Register `fn(tables)` under `key`; `sql` is the same question for an independent SQL engine."""

    def wrap(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if key in _QUERIES:
            raise ValueError(f"duplicate query key {key}")
        _QUERIES[key] = Query(key, fn, oracle(views, sql) if sql else None)
        return fn

    return wrap


def load() -> dict[str, Query]:
    for name in _MODULES:
        importlib.import_module(f"tilewater.plans.{name}")
    return _QUERIES


def callables() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    def bind(q: Query):
        return lambda spark, sf_dir: q.run(Tables(spark, sf_dir))

    return {k: bind(q) for k, q in load().items()}


def oracles() -> dict[str, str]:
    return {k: q.sql for k, q in load().items() if q.sql}
