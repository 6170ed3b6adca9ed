"""Places of rows within groups, without bringing a group into one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.shared import stage


def placed(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """The rows with ``at``: their place from 0 within the group, by ``order``, ascending and nulls first. A written table.

    Rows are dealt by ranges of (group, order), so a group of any size spreads over tasks.
    Each (group, task) counts its rows; only these counts meet per group. The sorted rows
    are written before they are counted, so a lost task cannot move them. ``group`` has no
    nulls; rows alike in all of ``order`` take places next to each other in any order.
    """
    keys = [F.col(group).asc(), *[F.col(c).asc_nulls_first() for c in order]]
    dealt = rows.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt, _ = stage(dealt.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("line")), "sorted")
    counts = dealt.groupBy(F.col(group).alias("of"), F.col("part").alias("in")).agg(F.min("line").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("of").orderBy("in")) - F.col("n")
    starts = counts.select("of", "in", (before - F.col("first")).alias("shift"))
    found = dealt.join(starts, (F.col(group) == F.col("of")) & (F.col("part") == F.col("in")))
    return stage(found.select(*rows.columns, (F.col("line") + F.col("shift")).alias("at")), "placed")[0]
