"""The registered queries by name, each with its SQL where there is one."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def add(name: str, run: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    if name in QUERIES:
        raise ValueError(f"two queries are called {name}")
    QUERIES[name] = run
    if sql:
        SQL[name] = sql


def query(name: str, sql: str | None = None):
    """Registers a function of (spark, sf_dir)."""

    def put(run):
        add(name, run, sql)
        return run

    return put
