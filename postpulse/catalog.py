"""Registered queries: one Spark job per survey key, plus its DuckDB oracle.

Every query reads the landed tables under ``base`` (or data Spark derives from
them) in full. ``ORACLES`` holds ANSI SQL over the same tables for keys whose
result is expressible in SQL; keys without one (model fits, iterative tree
growth) are checked by row count here and against brute force in ``tests/``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(key: str, sql: str | None = None):
    def wrap(fn):
        if key in QUERIES:
            raise KeyError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if sql is not None:
            ORACLES[key] = sql.strip()
        return fn
    return wrap


def _load_all() -> None:
    # importing the modules fills the registries
    from postpulse.plans import (queries_bagging, queries_engagement,  # noqa: F401
                                 queries_features, queries_models, queries_sampling,
                                 queries_sources)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    if not QUERIES:
        _load_all()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    if not QUERIES:
        _load_all()
    return dict(ORACLES)
