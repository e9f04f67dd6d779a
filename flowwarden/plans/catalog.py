"""Registry of named queries: each is ``fn(spark, sf_dir) -> DataFrame`` with an
optional DuckDB oracle statement over the same base tables."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def load_all() -> None:
    # importing the modules registers their queries
    from . import q_alerts, q_features, q_quality, q_windows, q_ml, q_streams, q_sources  # noqa: F401
