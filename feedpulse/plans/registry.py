"""Registered queries: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: QueryFn) -> QueryFn:
        old = QUERIES.get(name)
        if old is not None and (old.__module__, old.__qualname__) != (fn.__module__, fn.__qualname__):
            raise ValueError(f"duplicate query {name}")  # a module re-import re-registers itself
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> None:
    """Import every query module so their ``register`` calls run."""
    from feedpulse.plans import (q_trend, q_kpi, q_schema, q_text, q_features,  # noqa: F401
                                 q_models, q_timeseries, q_alerts, q_io, q_stream, q_rules, q_feed, q_host)
