"""Registered queries and their DuckDB equivalents.

``query`` registers a function (spark, sf_dir) -> DataFrame under its name.
Importing the operator modules fills the two tables.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from marlstone.sources.views import tables_read_once

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        @functools.wraps(f)
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            with tables_read_once():
                return f(spark, sf_dir)

        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


def load() -> None:
    """Import every module that registers queries."""
    from marlstone.operators import audits, belief, categorical, evaluation, groups, nulls, observing, rescoring, scoring, shrink, splits, text, training, truncated, verify  # noqa: F401
    from marlstone.sources import bundles, dimensions, episode_log, generations, resources  # noqa: F401
    from marlstone.streaming import monitors, streams  # noqa: F401
