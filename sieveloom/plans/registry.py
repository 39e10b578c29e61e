"""The registry of named queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under ``name``."""

    def register(f: Callable[[SparkSession, str], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"{name} stands twice")
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return register


def check_grid(frame: DataFrame, keys: list[str]) -> None:
    """Raise, with examples, where ``keys`` do not identify a row."""
    bad = frame.groupBy(*keys).count().where("count > 1").limit(5).collect()
    if bad:
        raise ValueError(f"not unique: {[tuple(r) for r in bad]}")
