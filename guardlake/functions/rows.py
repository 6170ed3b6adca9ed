"""Arrays to rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def exploded(df: DataFrame, keep: list, array: str | Column, name: str) -> DataFrame:
    """One row per element of a computed array.

    The plain ``explode`` makes the optimizer push a size test on the whole array
    expression below it, so every pattern in it would run twice; the outer form
    followed by a null test on its output does not.
    """
    return df.select(*keep, F.explode_outer(array).alias(name)).filter(F.col(name).isNotNull())


def posexploded(df: DataFrame, keep: list, array: str | Column, pos: str, name: str) -> DataFrame:
    return df.select(*keep, F.posexplode_outer(array).alias(pos, name)).filter(F.col(pos).isNotNull())


def let(value: Column, use) -> Column:
    """``use(value)`` with the value worked out once, however often ``use`` reads it.

    Chained columns that read their predecessor twice double with every step when
    the optimizer inlines them (as it does below a filter); a bound lambda
    variable does not.
    """
    return F.element_at(F.transform(F.array(value), use), 1)


def running_starts(lengths: Column, chunk: int = 64) -> Column:
    """Sums of all earlier elements for each element of an int array.

    Works by chunks: a sum per chunk, then short sums inside each, so that an
    array of n elements takes about n * chunk / 2 additions.
    """
    def spread(parts: Column) -> Column:
        sums = F.transform(parts, lambda p: F.aggregate(p, F.lit(0), lambda a, b: a + b))
        bases = F.aggregate(
            sums, F.struct(F.array().cast("array<int>").alias("out"), F.lit(0).alias("sum")),
            lambda s, v: F.struct(F.concat(s["out"], F.array(s["sum"])).alias("out"), (s["sum"] + v).alias("sum")),
            lambda s: s["out"])
        return let(bases, lambda b: F.flatten(F.transform(parts, lambda p, c: F.transform(
            p, lambda _, i: F.get(b, c) + F.aggregate(F.slice(p, 1, i), F.lit(0), lambda x, y: x + y)))))

    def cut(x: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / chunk).cast("int")),
                           lambda c: F.slice(x, c * chunk + 1, chunk))

    return let(lengths, lambda x: F.when(F.size(x) == 0, F.array().cast("array<int>")).otherwise(let(cut(x), spread)))
