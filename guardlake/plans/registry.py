"""Named queries: each takes (spark, folder of the tables) and returns a DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    def keep(build):
        QUERIES[name] = build
        return build
    return keep


def csv(col) -> Column:
    """Arrays are shown as comma-joined text in query results."""
    return F.array_join(col, ",")


def all_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from guardlake.plans import q_decide, q_ops, q_serve, q_text  # noqa: F401  (they register)
    return dict(QUERIES)
