"""Names of queries, their callables and their DuckDB oracles."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cataloom.session import ship_package

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}
_OPERATORS: dict[str, str] = {}
#: Modules that register queries.
_MODULES = ("queries_passes", "queries_resolution", "queries_rules", "queries_files", "queries_scans", "queries_filters", "queries_windows", "queries_aggregates", "queries_joins", "queries_scalars", "queries_preferences", "queries_streams")


def _load() -> None:
    for name in _MODULES:
        importlib.import_module(f"cataloom.plans.{name}")


def shipped(query: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """The query, run when the executors have the package."""

    @functools.wraps(query)
    def run(spark: SparkSession, *args: object) -> DataFrame:
        ship_package(spark)
        return query(spark, *args)

    return run


def register(name: str, operators: str, oracle: str | None = None) -> Callable:
    """Register a query under a name, with the operators that it covers, and its oracle where SQL expresses it."""

    def keep(query: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        _QUERIES[name] = shipped(query)
        _OPERATORS[name] = operators
        if oracle:
            _ORACLES[name] = oracle
        return query

    return keep


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_ORACLES)


def operators() -> dict[str, str]:
    """Query name -> the operators that it covers."""
    _load()
    return dict(_OPERATORS)
