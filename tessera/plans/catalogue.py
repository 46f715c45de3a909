"""The registered queries on the star-schema and event tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]
_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def register(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a query under its function name, with its SQL if there is any."""

    def keep(query: Query) -> Query:
        _queries[query.__name__] = query
        if sql:
            _sql[query.__name__] = sql
        return query

    return keep


def oracle(name: str) -> str:
    """SQL of a query that is registered already, to build another one's on."""
    return _sql[name]


def _load() -> None:
    import importlib

    for module in ("event_joins", "profile", "sequences", "settings", "signals", "evidence", "more_signals", "profile_fit", "takes", "scores", "stored", "archives", "clips", "moved", "bracket_lines", "assigned", "sectioned", "structures", "spectral", "settled", "survived", "pictured"):
        importlib.import_module(f"tessera.plans.{module}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql)
