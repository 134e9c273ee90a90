"""Queries of this subpackage: name -> (builder, DuckDB SQL or None)."""

from __future__ import annotations

LLM_QUERIES: dict[str, tuple] = {}


def query(name: str, sql: str | None = None):
    def deco(fn):
        LLM_QUERIES[name] = (fn, sql)
        return fn
    return deco
