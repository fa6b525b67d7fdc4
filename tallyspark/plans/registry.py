"""Registry of named queries: a Spark builder and (optionally) a DuckDB oracle.

A query module calls :func:`register` at import time; ``__spark_entry__``
exposes :func:`queries` and :func:`oracle_sql`. Every builder reads the given
tables (or data Spark derives from them) under ``sf_dir``.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Builder = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Builder
    sql: str | None
    doc: str


_REGISTRY: dict[str, Query] = {}


def register(name: str, sql: str | None = None):
    def deco(fn: Builder) -> Builder:
        if name in _REGISTRY:
            raise ValueError(f"duplicate query {name}")
        _REGISTRY[name] = Query(name, fn, sql, (fn.__doc__ or "").strip())
        return fn
    return deco


def _load_all() -> None:
    # importing the modules registers their queries
    from . import q_scoring, q_arena, q_text, q_grids, q_ingest, q_sampling, q_stream  # noqa: F401


def all_queries() -> dict[str, Query]:
    _load_all()
    return dict(_REGISTRY)
