"""Registered queries: a DataFrame builder and, where SQL can say it, the answer."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from riskloom.plans.frames import DAY, Frames
from riskloom.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ANSWERS: dict[str, str] = {}


def query(sql: str | None = None, size: str = DAY, name: str | None = None):
    """Register ``fn(frames) -> DataFrame`` under its own name."""

    def register(fn: Callable[[Frames], DataFrame]):
        key = name or fn.__name__

        def run(spark: SparkSession, folder: str) -> DataFrame:
            ship_package(spark)
            return fn(Frames(spark, folder, size))

        run.__name__, run.__doc__ = key, fn.__doc__
        QUERIES[key] = run
        if sql is not None:
            ANSWERS[key] = sql
        return fn

    return register


def load() -> None:
    """Import the query modules, which register themselves."""
    from riskloom.plans import (  # noqa: F401
        audit_queries,
        context_queries,
        decision_queries,
        feedback_queries,
        model_queries,
    )
