"""Registry of named queries: Spark plan plus its DuckDB oracle text.

A query is registered with ``@query(name, sql)`` where the function takes
``(spark, sf_dir)`` and returns a lazy DataFrame; ``sql`` is the oracle
statement, or ``None`` for operators checked by row count and invariants.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Entry:
    name: str
    fn: QueryFn
    sql: str | None


REGISTRY: dict[str, Entry] = {}


def query(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query name {name}")
        REGISTRY[name] = Entry(name, fn, sql)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    """Import every module that registers queries."""
    from ratewise.plans import (  # noqa: F401
        q_ingest, q_profile, q_clean, q_features, q_aggregates, q_series,
        q_elasticity, q_anomaly, q_scenarios, q_recommend, q_policy, q_models, q_segments,
    )
    return REGISTRY
