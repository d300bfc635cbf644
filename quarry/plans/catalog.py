"""Registry of named queries (Spark) and their SQL twins (DuckDB oracle).

Every query reads whole driver tables or tables Spark derives from them
(``quarry.plans.derived``); none filters to a subset of ids or rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

REGISTRY: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import the modules that register queries."""
    from quarry.plans import (q_checks, q_cluster, q_distrib, q_io, q_metrics, q_ml,  # noqa: F401
                              q_prep, q_profile, q_split)
