"""Registry of the queries over the driver's tables and their DuckDB forms."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
MODULES = ("flow", "features", "labels", "statistics", "state", "composed", "rest")


def query(name: str, sql: str | None = None):
    """Registers a query (spark, sf_dir) and its SQL."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"orderloom.plans.{m}")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
