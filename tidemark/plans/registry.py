"""Registered queries: a Spark callable and, where SQL can say it, the same thing in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import utc

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


@dataclass(frozen=True)
class Query:
    name: str
    operators: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None


REGISTRY: dict[str, Query] = {}


def query(operators: str, sql: str | None = None):
    """Register a function (spark, sf_dir) under its own name."""
    def add(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(utc(spark), sf_dir.rstrip("/"))
        REGISTRY[fn.__name__] = Query(fn.__name__, operators, run, sql)
        return fn
    return add
