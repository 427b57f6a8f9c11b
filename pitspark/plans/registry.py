"""Registered queries: a Spark callable, its SQL check text and the survey rows it covers."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from ..session import configure

QueryFn = Callable[[SparkSession, str], DataFrame]


@dataclass(frozen=True)
class Registered:
    name: str
    run: QueryFn
    sql: str | None
    covers: tuple[str, ...]
    module: str = ""


REGISTRY: dict[str, Registered] = {}


def query(covers: str, sql: str | None = None, name: str | None = None):
    """Register ``fn(spark, sf_dir)``; ``covers`` lists survey ids, ``sql`` is the DuckDB check."""

    def wrap(fn: QueryFn) -> QueryFn:
        key = name or fn.__name__
        if key in REGISTRY:
            raise ValueError(f"query {key} registered twice")

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return fn(configure(spark), sf_dir)

        REGISTRY[key] = Registered(key, run, sql, tuple(covers.split()), fn.__module__.rsplit(".", 1)[-1])
        return fn

    return wrap
