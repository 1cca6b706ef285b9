"""Names of the registered queries with their Spark and SQL forms."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from factfeed.session import tune

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def check(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(tune(spark), sf)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = run
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def load() -> None:
    """Import the modules that register the queries."""
    from . import (  # noqa: F401
        q_annotation,
        q_answering,
        q_experience,
        q_metrics,
        q_question_sets,
        q_retrieval,
        q_rewards,
        q_sources,
    )
