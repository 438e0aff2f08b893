"""The query catalogue: name -> (Spark query, plain SQL for the same rows)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return add


def load() -> None:
    """Imports the modules that fill the catalogue."""
    from capsift.plans import (  # noqa: F401
        q_audit, q_builds, q_compress, q_cuts, q_git, q_json, q_ledger, q_lists, q_logs, q_noise, q_tools)
