"""An audit store that is read in part: columnar files by date and part of the key, with a list of what each holds.

Events of a key lie in one part (a hash of the key), sorted by key, with a Bloom filter per row group, so a
lookup opens the parts of its keys only and, of those, the row groups that may hold them.  A list of
rows and times per date tells how far back the newest events reach.  A key with most of
the events of a day is spread over ``files`` files by hour.  A null key has a part as well.
``parts`` * ``files`` is the number of files of a date and append: take as many as give files of some 100 MB or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.operators.running import HOUR_US

PARTS = 32


def part_of(key: str, parts: int = PARTS) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")


def append(events: DataFrame, path: str, key: str, us: str = "us", parts: int = PARTS, files: int = 4) -> None:
    """Add events (with an ``event_date``) to the store, then what they are to its list.

    The list is written last; events of an append that failed before are in the files
    but may lie outside what ``newest`` takes for the last dates, until the append is repeated.
    """
    spread = F.pmod(F.xxhash64(key, F.floor(F.col(us) / HOUR_US)), F.lit(files))
    rows = events.withColumn("part", part_of(key, parts))
    (rows.repartition("event_date", "part", spread).sortWithinPartitions("event_date", "part", key, us)
     .write.mode("append").option(f"parquet.bloom.filter.enabled#{key}", "true")
     .partitionBy("event_date", "part").parquet(f"{path}/events"))
    counts = events.groupBy("event_date").agg(F.count(F.lit(1)).alias("events"), F.min(us).alias("first_us"), F.max(us).alias("last_us"))
    counts.coalesce(1).write.mode("append").parquet(f"{path}/dates")


def stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    """All events; ``like`` has their columns."""
    schema = like.withColumn("part", F.lit(0)).schema
    return spark.read.schema(schema).parquet(f"{path}/events")


def lookup(store: DataFrame, wanted: DataFrame, key: str, parts: int = PARTS) -> DataFrame:
    """All events of the wanted keys, from the parts that can hold them (at most ``parts`` numbers pass the driver)."""
    hit = [r[0] for r in wanted.select(part_of(key, parts)).distinct().collect()]
    return store.filter(F.col("part").isin(hit)).join(wanted.select(key).distinct(), key, "left_semi").drop("part")


def newest(store: DataFrame, dates: DataFrame, n: int, order: tuple[str, ...] = ("us", "event_id")) -> DataFrame:
    """The last ``n`` events in time, from the dates that hold them (one row per date passes the driver).

    Dates are those of the events' times, so a later date holds later events only.
    """
    kept, since = 0, None
    for row in dates.groupBy("event_date").agg(F.sum("events").alias("events")).orderBy(F.desc("event_date")).toLocalIterator():
        kept, since = kept + row["events"], row["event_date"]
        if kept >= n:
            break
    near = store.filter(F.lit(False)) if since is None else store.filter(F.col("event_date") >= F.lit(since))
    return near.orderBy(*[F.desc(c) for c in order]).limit(n).drop("part")
