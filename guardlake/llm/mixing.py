"""Mixing sources to target word counts by entropy balancing.

Every document of a source gets a rate, the number of copies the mix should take of it,
between 0 and ``most``. Of all rates that meet the source's target in words, balancing
picks those closest (in entropy) to equal rates for all documents: an exponential tilt
of the odds, ``rate = most / (1 + exp(-a - b * x))`` with ``x`` the square root of the
document's size over the source's mean size, one ``b`` per source. ``b`` is the root
of a convex dual and is found by Newton steps, kept inside a bracket that halves when a
step leaves it. A step is one aggregate over all sources at once.

The dual depends on a document only by its source and size, so all steps run on counts
per (source, size), which equal sizes and copies shrink. Sums are of whole numbers
(rates in 2^-20), so neither task order nor retries change a result.

Rates become copies per (source, size), from the longest size down: the copies of one
size make up for what rounding the sizes before left over, so a source ends within
about half of its smallest documents of its target. Copies that do not divide evenly
among documents of one size go to exactly as many of those with the lowest hash of
doc_id and text: counts per range of hashes find the range in which they run out, and
only that one is ranked.

Defined results: a null text has no words and is never taken; a null source is a source
of its own and the last; a source without words has target 0; rows that repeat a doc_id
are mixed row by row; of rows with the same doc_id and text any may get the last copies; an empty table gives no rows; further columns are
carried along and never read.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.shared import WORD, drop, packed, stage

WEIGHTS = (5, 2, 1)
UNIT = 1 << 20
#: (source, size) rows up to which their table is broadcast to the documents; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: Bits of a hash that are dropped for its range: 1,024 ranges.
RANGE_BITS = 54


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """Per source: source, source_size, target. ``sizes`` has (source, words): one row per source.

    Targets follow the weights up to ``most`` times the source's size; what is cut off goes
    to the others by weight, until none is above. Each round is one small aggregate.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())  # one row per source
    rank = (F.row_number().over(order) - 1) % len(WEIGHTS)
    rows, path = stage(sizes.select("source", F.col("words").alias("source_size"),
                                    F.get(F.array(*map(F.lit, WEIGHTS)), rank).alias("weight")), "sources")
    left = share * (rows.agg(F.sum("source_size")).first()[0] or 0)
    full = F.lit(False)
    level = 0.0
    while True:
        free = rows.filter(~full).agg(F.sum("weight")).first()[0]
        capped = rows.filter(full).agg(F.sum("source_size")).first()[0] or 0
        if not free:
            break
        new = (left - most * capped) / free
        if new <= level:
            break
        level = new
        full = F.col("weight") * F.lit(level) > most * F.col("source_size")
    return rows.select("source", "source_size", F.least(F.col("weight") * F.lit(level), (most * F.col("source_size")).cast("double")).alias("target"))


def _rate(b: Column, x: Column, start: float, most: int) -> Column:
    """The tilted rate; the exponent stays where exp is finite."""
    return most / (1 + F.exp(-F.greatest(F.least(start + b * x, F.lit(40.0)), F.lit(-40.0))))


def balanced(classes: DataFrame, aims: DataFrame, share: float = 1.5, most: int = 2, rounds: int = 60) -> DataFrame:
    """Rates per (source, size, n): the dual of each source is solved by bracketed Newton steps."""
    start = math.log(min(share, most * 0.999) / (most - min(share, most * 0.999)))
    mean = classes.groupBy("source").agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"))
    facts = mean.join(aims.withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    state, path = stage(facts.select("source", "mean", "target", "source_size", F.lit(0.0).alias("b"), F.lit(-60.0).alias("low"), F.lit(60.0).alias("high"),
                                     F.lit(False).alias("done")), "dual")
    spark = classes.sparkSession

    def tilted(dual: DataFrame) -> DataFrame:
        known = dual.withColumnRenamed("source", "of")
        rows = classes.join(known, F.col("source").eqNullSafe(F.col("of")))
        x = F.sqrt(F.col("size") / F.col("mean"))
        return rows.withColumn("x", x).withColumn("rate", _rate(F.col("b"), x, start, most))

    for _ in range(rounds):
        fixed = (F.col("rate") * UNIT).cast("long")
        slope = F.floor(F.col("rate") * (1 - F.col("rate") / most) * F.col("x") * UNIT)
        sums = tilted(state.filter("NOT done")).groupBy("of").agg(
            F.sum(F.col("size") * F.col("n") * fixed).alias("value"), F.sum(F.col("size") * F.col("n") * slope).alias("slope"))
        gap = F.col("value") / UNIT - F.col("target")
        low = F.when(gap < 0, F.col("b")).otherwise(F.col("low"))
        high = F.when(gap > 0, F.col("b")).otherwise(F.col("high"))
        step = F.col("b") - gap / F.greatest(F.col("slope") / UNIT, F.lit(1e-9))
        new = F.when((step > low) & (step < high), step).otherwise((low + high) / 2)
        met = F.abs(gap) <= 1e-5 * F.col("target") + 0.5
        done = F.col("value").isNull() | met | (F.col("high") - F.col("low") < 1e-9)
        moved = state.join(sums, F.col("source").eqNullSafe(F.col("of")), "left")
        fresh = moved.select("source", "mean", "target", "source_size", F.when(done, F.col("b")).otherwise(new).alias("b"),
                             F.when(done, F.col("low")).otherwise(low).alias("low"),
                             F.when(done, F.col("high")).otherwise(high).alias("high"), done.alias("done"))
        fresh, new_path = stage(fresh, "dual")
        drop(spark, path)
        state, path = fresh, new_path
        if not fresh.filter("NOT done").take(1):
            break
    return tilted(state).select("source", "size", "n", F.when(F.col("target") >= most * F.col("source_size"), F.lit(float(most))).otherwise(
        F.col("rate")).alias("rate"))


def _rounded(group: pd.DataFrame, most: int) -> pd.DataFrame:
    """Copies of each size of one source, longest first, carrying over the words left."""
    rows = group.sort_values("size", ascending=False)
    over, copies = 0.0, []
    for size, n, rate in zip(rows["size"], rows["n"], rows["rate"]):
        wanted = over + rate * n * size
        k = min(max(math.floor(wanted / size + 0.5), 0), most * n)
        over = wanted - k * size
        copies.append(k)
    return rows.assign(copies=copies)[["source", "size", "n", "copies"]]


def plan(docs: DataFrame, share: float = 1.5, most: int = 2) -> tuple[DataFrame, DataFrame]:
    """Copies per (source, size) and the targets, both written tables. ``docs``: source, size."""
    classes, _ = stage(docs.groupBy("source", "size").agg(F.count(F.lit(1)).alias("n")), "classes")
    aims, _ = stage(targets(classes.groupBy("source").agg(F.sum(F.col("size") * F.col("n")).alias("words")), share, most), "targets")
    rates = balanced(classes.filter("size > 0"), aims, share, most)
    # A source has at most one row per size here: as many as its longest text has words, however many documents.
    copies = rates.groupBy("source").applyInPandas(lambda g: _rounded(g, most), "source string, size long, n long, copies long")
    return stage(copies, "copies")[0], aims


def lot(docs: DataFrame) -> Column:
    """The hash by which copies are dealt among documents of one size."""
    return F.xxhash64(docs["doc_id"], docs["text"], F.lit(9))


def _last(rows: DataFrame, copies: DataFrame, small: bool) -> DataFrame:
    """Per (of, of_size) whose copies do not divide evenly: the last lot that gets one more, its rows and how many of them do."""
    def met(left: DataFrame, right: DataFrame) -> DataFrame:
        on = F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size"))
        return left.join(F.broadcast(right) if small else right, on)

    def crossed(counted: DataFrame, by: str, wanted: str) -> DataFrame:
        below = F.sum("rows").over(Window.partitionBy("source", "size").orderBy(by)) - F.col("rows")
        return counted.withColumn("below", below).filter((F.col("below") < F.col(wanted)) & (F.col("below") + F.col("rows") >= F.col(wanted)))

    of = copies.select(F.col("source").alias("of"), F.col("size").alias("of_size"), (F.col("copies") % F.col("n")).alias("odd")).filter("odd > 0")
    near = met(rows.select("source", "size", "lot"), of).select("source", "size", "odd", "lot", F.shiftright("lot", RANGE_BITS).alias("range"))
    ranges = crossed(near.groupBy("source", "size", "odd", "range").agg(F.count(F.lit(1)).alias("rows")), "range", "odd")
    edge = ranges.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("range").alias("of_range"), (F.col("odd") - F.col("below")).alias("rest"))
    inside = met(near, edge).filter("range = of_range").groupBy("source", "size", "rest", "lot").agg(F.count(F.lit(1)).alias("rows"))
    last = crossed(inside, "lot", "rest")
    return stage(last.select(F.col("source").alias("of"), F.col("size").alias("of_size"), F.col("lot").alias("last"), F.col("rows").alias("ties"),
                             (F.col("rest") - F.col("below")).alias("more")), "lots")[0]


def _copies(rows: DataFrame, copies: DataFrame, lots: DataFrame) -> DataFrame:
    """Rows (source, size, lot, ...) with their number of copies. ``lots``: source, size and lot of all rows."""
    small = copies.count() <= BROADCAST_ROWS
    last = _last(lots, copies, small)
    per = copies.select("source", "size", F.floor(F.col("copies") / F.col("n")).alias("each")).join(
        last, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")), "left").select(
        F.col("source").alias("of"), F.col("size").alias("of_size"), "each", "last", "ties", "more")
    found = rows.join(F.broadcast(per) if small else per, F.col("source").eqNullSafe(F.col("of")) & (F.col("size") == F.col("of_size")), "left")
    tied = F.coalesce((F.col("lot") == F.col("last")) & (F.col("more") < F.col("ties")), F.lit(False))
    dealt = found.withColumn("one", F.when(F.col("lot") <= F.col("last"), 1).otherwise(0))
    if last.filter("more < ties").take(1):  # rows with the same doc_id and text, of which some get one more
        rank = F.row_number().over(Window.partitionBy("source", "size", "lot").orderBy(F.lit(1)))
        some = found.filter(tied).withColumn("one", F.when(rank <= F.col("more"), 1).otherwise(0))
        dealt = dealt.filter(~tied).unionByName(some)
    return dealt.withColumn("times", F.coalesce(F.col("each") + F.col("one"), F.lit(0)).cast("long")).drop(
        "of", "of_size", "each", "last", "ties", "more", "one", "lot")


def report(docs: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """Per document: doc_id, size, source_size, target, taken."""
    rows, _ = stage(docs.select("doc_id", "source", words(docs["text"]).alias("size"), lot(docs).alias("lot")), "sizes")
    copies, aims = plan(rows, share, most)
    aims = aims.withColumnRenamed("source", "from")
    found = _copies(rows, copies, rows).join(aims, F.col("source").eqNullSafe(F.col("from")))
    return found.select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).alias("taken"))


def mixed(docs: DataFrame, share: float = 1.5, most: int = 2) -> DataFrame:
    """The mix itself: each document as often as it is taken, with its columns as they are."""
    size = words(docs["text"])
    lots, _ = stage(docs.select("source", size.alias("size"), lot(docs).alias("lot")), "sizes")
    copies, _ = plan(lots, share, most)
    rows = _copies(packed(docs, source=docs["source"], size=size, lot=lot(docs)), copies, lots)
    return rows.filter("times > 0").select("doc", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("doc.*")
