"""Operating figures and inactivity sessions on streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake.operators.kpi import kpi_columns, kpi_windows
from guardlake.sources import tables
from guardlake.spark import shared_folder
from guardlake.streaming import files

LATENESS = "10 minutes"


def kpis(log: DataFrame, width: str = "1 hour", slide: str | None = None, lateness: str = LATENESS) -> DataFrame:
    """Counts per event-time window; rows later than the watermark are left to the batch reconcile."""
    window = F.window("event_time", width, slide) if slide else F.window("event_time", width)
    return (log.withWatermark("event_time", lateness).groupBy(window.alias("w")).agg(*kpi_columns())
            .withColumn("bucket_s", F.unix_seconds("w.start")).drop("w"))


def sessions(events: DataFrame, key: str = "user_id", gap: str = "30 minutes", lateness: str = LATENESS) -> DataFrame:
    return (events.withWatermark("event_time", lateness).groupBy(key, F.session_window("event_time", gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select(key, F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "events"))


def reconcile(streamed: DataFrame, batch: DataFrame) -> DataFrame:
    """Buckets in which the stream counted fewer requests than the log holds (late rows)."""
    late = F.col("requests") - F.coalesce("streamed_requests", F.lit(0))
    return (batch.select("bucket_s", "requests")
            .join(streamed.select("bucket_s", F.col("requests").alias("streamed_requests")), "bucket_s", "left")
            .withColumn("late_requests", late).filter(F.col("late_requests") > 0))


def add_partials(rows: DataFrame, path: str, batch_id: int, width_s: int = 3600, dims: tuple[str, ...] = ()) -> None:
    """Counts of one batch of rows per bucket, in a folder of its own; a batch that comes again overwrites its folder."""
    (kpi_windows(rows, width_s, dims).drop("deny_rate").withColumn("batch_id", F.lit(batch_id).cast("long"))
     .write.mode("overwrite").parquet(f"{path}/batch={batch_id}"))


def merged(partials: DataFrame, dims: tuple[str, ...] = ()) -> DataFrame:
    """Buckets as sums of their partial counts, so that a late row adds to its bucket and nothing is read again."""
    counts = [c for c in partials.columns if c not in ("bucket_s", "batch_id", "batch", *dims)]
    return (partials.groupBy("bucket_s", *dims).agg(*[F.sum(c).alias(c) for c in counts])
            .withColumn("deny_rate", F.round(F.col("denied") / F.col("requests"), 6)))


def run_partials(log: DataFrame, width_s: int = 3600, dims: tuple[str, ...] = (), path: str | None = None) -> DataFrame:
    """Run a log stream into partial counts and merge them.

    Every row is counted however late it is: there is no watermark and no state, only one small row per batch, bucket
    and segment.  ``path`` goes on where a former run ended; by default a new folder is taken.
    """
    path = path or f"{shared_folder(log.sparkSession)}/partials-{uuid.uuid4().hex}"
    (log.writeStream.option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
     .foreachBatch(lambda batch, batch_id: add_partials(batch, f"{path}/out", batch_id, width_s, dims)).start().awaitTermination())
    return merged(log.sparkSession.read.parquet(f"{path}/out"), dims)


def replay(spark, folder: str) -> DataFrame:
    """Drive the stream over the whole event table; buckets that lost late rows are counted again from the table."""
    streamed = files.run_updates(kpis(files.log_stream(spark, folder)), ["bucket_s"])
    log = spark.sql(tables.FX_LOG, events=files.events_table(spark, folder)).withColumn("us", F.unix_micros(tables.as_utc(F.col("ts"))))
    batch = kpi_windows(log, 3600).drop("deny_rate")
    late = reconcile(streamed, batch).select("bucket_s")
    return streamed.join(late, "bucket_s", "left_anti").unionByName(batch.join(late, "bucket_s", "left_semi").select(*streamed.columns))
