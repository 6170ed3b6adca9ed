"""A blocked Bloom filter of the keys that may occur twice, as a table of bitmaps.

One block is a bitmap of 32,768 bits (4 KiB), made by Spark's bitmap aggregate. A
key picks its block and ``HASHES`` bits in it. The first pass counts how often each
bit is hit and keeps bits hit twice; the second tests every key against them. A key
that occurs twice hits its bits twice, so it always passes the test; a key that
occurs once passes it rarely. The table has at most ``max_mb`` megabytes whatever
the input, so it may be broadcast. Past that size (16 bits a key, 33 million keys
for 64 MB) more single keys pass the test; results that verify stay exact.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK_BITS = 32768
HASHES = 4
BITS_PER_KEY = 16


def _bit(key: Column, i: int) -> Column:
    return F.pmod(F.xxhash64(key, F.lit(i)), F.lit(BLOCK_BITS))


def repeated(keys: DataFrame, key: str, rows: int, max_mb: int = 64, least: int = 2) -> tuple[DataFrame, int]:
    """The filter of keys that may occur ``least`` times or more, and its number of blocks."""
    blocks = max(1, min(math.ceil(rows * BITS_PER_KEY / BLOCK_BITS), max_mb * 256))
    bits = keys.select(F.pmod(F.xxhash64(key), F.lit(blocks)).alias("block"),
                       F.explode(F.array(*[_bit(F.col(key), i) for i in range(HASHES)])).alias("bit"))
    twice = bits.groupBy("block", "bit").count().filter(F.col("count") >= least)
    return twice.groupBy("block").agg(F.bitmap_construct_agg("bit").alias("bitmap")), blocks


def tested(rows: DataFrame, key: str, filter_: tuple[DataFrame, int]) -> DataFrame:
    """Rows with a boolean ``maybe``: whether the filter holds the key."""
    bitmaps, blocks = filter_

    def held(i: int) -> Column:
        bit = _bit(F.col(key), i)
        byte = F.conv(F.hex(F.substring(F.col("bitmap"), F.floor(bit / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
        return F.getbit(byte, F.pmod(bit, F.lit(8)).cast("int")) > 0

    found = rows.withColumn("block", F.pmod(F.xxhash64(key), F.lit(blocks))).join(F.broadcast(bitmaps), "block", "left")
    test = F.lit(True)
    for i in range(HASHES):
        test = test & held(i)
    return found.withColumn("maybe", F.when(F.col("bitmap").isNull(), False).otherwise(test)).drop("block", "bitmap")
