"""Append-only sinks and the latest-state view of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_audit(events: DataFrame, path: str, files: int = 4) -> None:
    """Append events as JSON lines, one folder per date and event type with at most so many new files in each."""
    salt = F.pmod(F.xxhash64(*events.columns), F.lit(files))
    events.repartition("event_date", "event_type", salt).write.mode("append").partitionBy("event_date", "event_type").json(path)


def latest_by_key(writes: DataFrame, keys: list[str], payload: str, order: list[str]) -> DataFrame:
    """Last payload per key; one row per key and task leaves the map side."""
    return writes.groupBy(*keys).agg(F.max_by(payload, F.struct(*order)).alias(payload),
                                     F.max(F.struct(*order)).alias("at")).select(*keys, payload, "at.*")


def newest(latest: DataFrame, order: list[str], n: int) -> DataFrame:
    return latest.orderBy(*[F.desc(c) for c in order]).limit(n)
