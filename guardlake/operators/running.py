"""Running and trailing aggregates that hold up when one key has most of the rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000


def joined(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """An equality join in which a null key meets a null key, so that rows without a key stay. One copy of the keys remains."""
    names = {k: f"_of_{k}" for k in keys}
    right = right.withColumnsRenamed(names)
    same = reduce(lambda x, y: x & y, [left[k].eqNullSafe(right[names[k]]) for k in keys])
    return left.join(right, same, how).drop(*names.values())


def running_counts(log: DataFrame, keys: list[str], order: list[str], us: str, counts: dict[str, Column],
                   firsts: dict[str, Column] | None = None, source: DataFrame | None = None,
                   slot_us: int = HOUR_US) -> DataFrame:
    """Add, per row, sums (``counts``) and minima (``firsts``) over the key's earlier rows.

    Keys are cut into time slots.  Totals per (key, slot) are pre-aggregated,
    their prefix runs over one small row per slot, and each row adds what its own
    slot holds before it, so a hot key spreads over its slots.  ``source`` is the
    stored table with the same rows as ``log``: totals then read it rather than
    repeat the work behind ``log``.
    """
    firsts = firsts or {}
    slot = F.floor(F.col(us) / slot_us)
    totals = (log if source is None else source).withColumn("slot", slot).groupBy(*keys, "slot").agg(
        *[F.sum(c).cast("long").alias(f"t_{n}") for n, c in counts.items()], *[F.min(c).alias(f"t_{n}") for n, c in firsts.items()])
    upto = Window.partitionBy(*keys).orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    prefix = totals.select(*keys, "slot", *[F.coalesce(F.sum(f"t_{n}").over(upto), F.lit(0)).alias(f"p_{n}") for n in counts],
                           *[F.min(f"t_{n}").over(upto).alias(f"p_{n}") for n in firsts])
    local = Window.partitionBy(*keys, "slot").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    own = log.withColumn("slot", slot)
    own = own.select("*", *[F.coalesce(F.sum(c).over(local), F.lit(0)).cast("long").alias(f"l_{n}") for n, c in counts.items()],
                     *[F.min(c).over(local).alias(f"l_{n}") for n, c in firsts.items()])
    return (joined(own, prefix, [*keys, "slot"])
            .withColumns({**{n: F.col(f"l_{n}") + F.col(f"p_{n}") for n in counts},
                          **{n: F.least(f"l_{n}", f"p_{n}") for n in firsts}})
            .drop("slot", *[f"{p}_{n}" for p in "lp" for n in (*counts, *firsts)]))


def sums_before(totals: DataFrame, keys: list[str], slot: str, total: str, name: str, fan: int = 4096) -> DataFrame:
    """Keys, slot and ``name``, the sum of ``total`` over the key's earlier slots, by slots of slots.

    A window sees at most ``fan`` slots, or ``fan`` slots of slots; the last one, over
    what is left, has a row for every ``fan`` * ``fan`` slots of the time axis.
    """
    up = lambda c: F.floor(F.col(c) / fan)
    levels, cols = [totals.select(*keys, slot, F.col(total).alias("_t"))], [slot]
    for i in (1, 2):
        cols.append(f"_above{i}")
        levels[-1] = levels[-1].withColumn(cols[-1], up(cols[-2]))
        levels.append(levels[-1].groupBy(*keys, cols[-1]).agg(F.sum("_t").alias("_t")))
    out = None
    for i in (2, 1, 0):
        within = [] if i == 2 else [cols[i + 1]]
        upto = Window.partitionBy(*keys, *within).orderBy(cols[i]).rowsBetween(Window.unboundedPreceding, -1)
        own = levels[i].select(*keys, *within, cols[i], F.coalesce(F.sum("_t").over(upto), F.lit(0)).alias("_own"))
        if out is not None:
            own = joined(own, out, [*keys, *within]).withColumn("_own", F.col("_own") + F.col("_b"))
        out = own.select(*keys, cols[i], F.col("_own").alias("_b"))
    return out.withColumnRenamed("_b", name)


def trailing_count(log: DataFrame, keys: list[str], us: str, row_id: str, window_us: int, name: str,
                   slot_us: int = HOUR_US, weight: Column | None = None) -> DataFrame:
    """Add the number of earlier rows of the key no older than the window (bound included), or the sum of their ``weight``.

    Each row counts +1 (or its weight) at its time and -1 just after it leaves the window, so the
    number of rows in the window is one running sum, whatever the window holds.
    Keys are cut into time slots: sums per (key, slot) are pre-aggregated, their
    prefix runs over one small row per slot, and each row adds what its own slot
    holds before it.  Without keys the slots themselves are summed by slots of slots.
    """
    mark = lambda at, kind: F.struct(at.alias("at"), F.lit(kind).alias("kind"), ((1 - 2 * kind) * (F.lit(1) if weight is None else weight)).alias("sign"))
    marked = log.withColumn("_m", F.explode(F.array(mark(F.col(us), 0), mark(F.col(us) + window_us, 1))))
    marked = marked.withColumn("_slot", F.floor(F.col("_m.at") / slot_us))
    totals = marked.groupBy(*keys, "_slot").agg(F.sum("_m.sign").alias("_sum"))
    if keys:
        upto = Window.partitionBy(*keys).orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
        before = totals.select(*keys, "_slot", F.coalesce(F.sum("_sum").over(upto), F.lit(0)).alias("_before"))
    else:
        before = sums_before(totals, keys, "_slot", "_sum", "_before")
    inside = Window.partitionBy(*keys, "_slot").orderBy("_m.at", "_m.kind", row_id).rowsBetween(Window.unboundedPreceding, -1)
    counted = marked.withColumn("_inside", F.coalesce(F.sum("_m.sign").over(inside), F.lit(0))).filter("_m.kind = 0")
    return (joined(counted, before, [*keys, "_slot"]).withColumn(name, F.col("_before") + F.col("_inside"))
            .drop("_m", "_slot", "_before", "_inside"))
