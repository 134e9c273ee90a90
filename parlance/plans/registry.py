"""Query registry: name -> (Spark builder, DuckDB oracle SQL or None)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, tuple[Builder, str | None]] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = (fn, sql)
        return fn
    return deco


def attach_oracle(name: str, sql: str) -> None:
    """Give an already registered query its oracle SQL (kept next to the oracle's own recipe)."""
    fn, old = REGISTRY[name]
    if old is not None:
        raise ValueError(f"{name} already has an oracle")
    REGISTRY[name] = (fn, sql)
