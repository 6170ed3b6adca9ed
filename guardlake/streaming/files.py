"""File streams in, exactly-once files out."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.sources import tables
from guardlake.spark import shared_folder

EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


def events_stream(spark: SparkSession, folder: str, files_per_batch: int = 1) -> DataFrame:
    """The events table as a stream; the files per batch bound what one batch holds."""
    # The glob finds a single file, several files, and the part files of a folder alike.
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", files_per_batch).parquet(f"{folder}/events*.parquet")


def events_table(spark: SparkSession, folder: str) -> DataFrame:
    """The same files as a table."""
    return spark.read.schema(EVENTS).parquet(f"{folder}/events*.parquet")


def log_stream(spark: SparkSession, folder: str, **kw) -> DataFrame:
    """The decision log overlay on the event stream, with an event time for watermarks."""
    log = spark.sql(tables.FX_LOG, events=events_stream(spark, folder, **kw))
    return (log.withColumn("event_time", tables.as_utc(F.col("ts")))
            .withColumn("us", F.unix_micros("event_time")).withColumn("reason_codes", F.array("reason_code")))


def run_append(stream: DataFrame) -> DataFrame:
    """Run a stream over what there is now into parquet files and read them back."""
    home = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"
    (stream.writeStream.format("parquet").outputMode("append").option("path", f"{home}/out")
     .option("checkpointLocation", f"{home}/checkpoint").trigger(availableNow=True).start().awaitTermination())
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{home}/out")


def run_updates(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Run an updating aggregate; each batch overwrites its own folder (a repeated batch
    is harmless) and the newest batch of a key counts."""
    home = f"{shared_folder(stream.sparkSession)}/stream-{uuid.uuid4().hex}"

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch_id", F.lit(batch_id)).write.mode("overwrite").parquet(f"{home}/out/part={batch_id}")

    (stream.writeStream.outputMode("update").option("checkpointLocation", f"{home}/checkpoint")
     .foreachBatch(write).trigger(availableNow=True).start().awaitTermination())
    rows = stream.sparkSession.read.parquet(f"{home}/out").drop("part")
    names = [n for n in stream.columns if n not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), "batch_id").alias("v")).select(*keys, "v.*")


def write_audit_stream(events: DataFrame, path: str, checkpoint: str):
    """Append audit events of a stream, one folder per date and type."""
    return (events.writeStream.format("json").outputMode("append").partitionBy("event_date", "event_type")
            .option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
