"""Registry of named queries (Spark callables) and their DuckDB oracle SQL.

Every query takes (spark, sf_dir) and returns a DataFrame computed over the whole driver tables or
views Spark derives from them. Oracle SQL is optional: keys without one are checked on row counts
only (models, file round trips, iterative algorithms with no closed SQL form).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(key: str, oracle: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if key in QUERIES:
            raise ValueError(f"duplicate query key {key}")
        QUERIES[key] = fn
        if oracle is not None:
            ORACLE[key] = oracle
        return fn

    return deco


def load_all() -> None:
    from .catalog import (  # noqa: F401
        aggregates, cleaning, encoders, evaluation, generators, joins, models, ordering, privacy,
        sampling, similarity, sources,
    )
