"""Every query of the library outside the corpus subpackage, with its DuckDB counterpart."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

#: Modules that register queries when imported.
PLANS = ("events", "search", "graph", "vectors", "scores", "text", "stateful", "records", "extract", "entities", "results", "files", "streams", "measured", "combined")
_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, run: Query, sql: str | None = None) -> None:
    """Register a query, and the SQL that must give the same rows where there is one."""
    if name in _QUERIES:
        raise ValueError(f"{name} is registered twice")
    _QUERIES[name] = run
    if sql is not None:
        _ORACLES[name] = sql


def _load() -> None:
    for plan in PLANS:
        importlib.import_module(f"tidemark.plans.{plan}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)
