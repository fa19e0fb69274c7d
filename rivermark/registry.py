"""The list of named queries, each with its builder and, where possible, its SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

Build = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Query:
    name: str
    build: Build
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(name: str, sql: str | None = None) -> Callable[[Build], Build]:
    """Register ``build(spark, sf_dir)`` under ``name``."""

    def register(build: Build) -> Build:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = Query(name, build, sql)
        return build

    return register
