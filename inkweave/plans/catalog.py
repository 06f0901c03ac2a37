"""The registry of named queries: each has a Spark side and, where SQL can express it, a DuckDB side."""

from __future__ import annotations

import importlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

#: Modules that register queries when they are imported.
MODULES = ["text_queries", "segment_queries", "graph_queries", "knowledge_queries", "matching_queries", "quality_queries", "relational_queries", "layout_queries", "context_queries", "store_queries", "stream_queries"]

_QUERIES: dict[str, "Query"] = {}


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    oracle: str | None
    covers: str


def query(name: str, covers: str, oracle: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under a name, with the operators that it covers."""

    def add(run: Callable[[SparkSession, str], DataFrame]):
        if name in _QUERIES:
            raise ValueError(f"query {name} is registered twice")
        _QUERIES[name] = Query(name, run, oracle, covers)
        return run

    return add


def load() -> dict[str, Query]:
    for module in MODULES:
        importlib.import_module(f"inkweave.plans.{module}")
    return dict(_QUERIES)
