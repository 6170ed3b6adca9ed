"""Latest value per key, kept as a base with deltas beside it.

A batch of writes is reduced to its own latest row per key and added as a delta; nothing older is read.
Readers merge base and deltas, and only those parts (hashes of the key) that have deltas are shuffled.
When the deltas of a part exceed a share of its base, ``compact`` writes that part anew as a further
generation, and leaves the other parts as they are.  A small list says which generation of a part
counts and up to which batch it holds the writes.  It is written last, so a failed or repeated
compaction changes nothing: generations that the list does not name are not read. Folded deltas and
former generations are left to the cluster's retention.
"""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType

LIST = "part int, generation long, upto long, base_rows long"


@dataclasses.dataclass(frozen=True)
class State:
    """Where the state is, and what its rows are: ``keys``, one ``payload``, and the columns that say which write is later."""
    path: str
    keys: tuple[str, ...]
    payload: str
    order: tuple[str, ...]
    schema: StructType
    parts: int = 32

    def columns(self) -> list[str]:
        return [*self.keys, self.payload, *self.order]

    def latest(self, rows: DataFrame) -> DataFrame:
        """The last write per key; of writes that tie in ``order`` the one with the greatest payload."""
        last = F.max(F.struct(*self.order, self.payload)).alias("_last")
        names = [c for c in ("part",) if c in rows.columns]
        return rows.groupBy(*names, *self.keys).agg(last).select(*names, *self.keys, *[F.col(f"_last.{c}").alias(c) for c in (self.payload, *self.order)])


def create(spark: SparkSession, state: State) -> None:
    """An empty state: every part at generation 0, with no rows."""
    rows = spark.range(state.parts).select(F.col("id").cast("int").alias("part"), F.lit(0).cast("long").alias("generation"),
                                           F.lit(-1).cast("long").alias("upto"), F.lit(0).cast("long").alias("base_rows"))
    rows.coalesce(1).write.mode("append").parquet(f"{state.path}/list")


def _list(spark: SparkSession, state: State) -> DataFrame:
    """The current generation of each part: one row per part, however many generations were written."""
    rows = spark.read.schema(LIST).parquet(f"{state.path}/list")
    return rows.groupBy("part").agg(F.max_by(F.struct("generation", "upto", "base_rows"), "generation").alias("s")).select("part", "s.*")


def _stored(spark: SparkSession, state: State, folder: str, number: str | None = None) -> DataFrame:
    fields = [f for f in state.schema.fields if f.name in state.columns()]
    numbers = [StructField(number, LongType())] if number else []
    return spark.read.schema(StructType([*fields, *numbers, StructField("part", IntegerType())])).parquet(f"{state.path}/{folder}")


def append(writes: DataFrame, state: State, batch: int) -> None:
    """Add the writes of one batch; batches are numbered upwards, and a repeated number overwrites its own folder."""
    part = F.pmod(F.xxhash64(*state.keys), F.lit(state.parts)).cast("int")
    latest = state.latest(writes.select(*state.columns()).withColumn("part", part))
    latest.write.mode("overwrite").partitionBy("part").parquet(f"{state.path}/delta/batch={batch}")


def _pieces(spark: SparkSession, state: State, batch: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Base and delta rows that count, each with its part; deltas up to a batch, or all."""
    now = _list(spark, state)
    delta = _stored(spark, state, "delta", "batch")
    delta = delta.join(F.broadcast(now.select("part", "upto")), "part").filter(F.col("batch") > F.col("upto"))  # one row per part
    delta = (delta if batch is None else delta.filter(F.col("batch") <= batch)).select("part", *state.columns())
    if now.filter("generation > 0").limit(1).count() == 0:  # generation 0 has no files
        return delta.limit(0), delta
    base = _stored(spark, state, "base", "generation")
    return base.join(F.broadcast(now.select("part", "generation")), ["part", "generation"], "left_semi").select("part", *state.columns()), delta


def read(spark: SparkSession, state: State) -> DataFrame:
    """The latest row of every key. Parts without deltas are read as they lie."""
    base, delta = _pieces(spark, state)
    dirty = F.broadcast(delta.select("part").distinct())  # at most the number of parts
    merged = state.latest(base.join(dirty, "part", "left_semi").unionByName(delta))
    return base.join(dirty, "part", "left_anti").unionByName(merged).select(*state.columns())


def compact(spark: SparkSession, state: State, batch: int, share: float = 0.2) -> list[int]:
    """Fold the deltas up to ``batch`` into the base where they exceed ``share`` of it; gives the parts written anew."""
    now = _list(spark, state)
    base, delta = _pieces(spark, state, batch)
    sizes = delta.groupBy("part").agg(F.count(F.lit(1)).alias("n")).join(now, "part")
    due = sizes.filter(F.col("n") > share * F.col("base_rows")).select("part", "generation").collect()  # at most the number of parts
    if not due:
        return []
    parts = [r["part"] for r in due]
    generation = max(r["generation"] for r in due) + 1
    ours = F.col("part").isin(parts)
    merged = state.latest(base.filter(ours).unionByName(delta.filter(ours)))
    folder = f"base/generation={generation}"
    # The folder may hold other parts from before, so only ours are overwritten.
    merged.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("part").parquet(f"{state.path}/{folder}")
    rows = (_stored(spark, state, folder).filter(ours).groupBy("part").agg(F.count(F.lit(1)).alias("base_rows"))
            .select("part", F.lit(generation).cast("long").alias("generation"), F.lit(batch).cast("long").alias("upto"), "base_rows"))
    rows.coalesce(1).write.mode("append").parquet(f"{state.path}/list")
    return sorted(parts)
