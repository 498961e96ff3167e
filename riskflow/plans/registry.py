"""Registry of the named queries (one per operator of the inventory) and of
their DuckDB oracle SQL.  ``__spark_entry__`` exposes both."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def register(name: str, oracle: str | None = None):
    """Decorator: register a (spark, sf_dir) -> DataFrame query and its SQL."""

    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return deco


def load_all() -> None:
    from . import (  # noqa: F401
        q_assemble,
        q_claims,
        q_entities,
        q_eval,
        q_jobs,
        q_monitor,
        q_quality,
        q_round_trips,
        q_sources,
        q_streaming,
        q_text,
        q_vectors,
    )
