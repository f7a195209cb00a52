"""Registry of the queries that run over the given tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Lazy access to the parquet tables of one scale folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")


@dataclass(frozen=True)
class Query:
    name: str
    ops: tuple[str, ...]
    build: Callable[[Tables], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(ops: str, sql: str | None = None):
    """Register a function of ``Tables`` under its own name with its SQL counterpart."""
    def add(fn: Callable[[Tables], DataFrame]):
        if fn.__name__ in QUERIES:
            raise ValueError(f"query registered twice: {fn.__name__}")
        QUERIES[fn.__name__] = Query(fn.__name__, tuple(ops.split()), fn, sql)
        return fn
    return add
