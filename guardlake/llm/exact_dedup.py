"""Exact dedup by two-pass Bloom filtering.

The first pass builds a filter of the text hashes that may occur twice, the second
tests every row against it. Rows that cannot be copies pass straight through; only
the others shuffle. The largest doc_id of equal texts stays.

Defined results: a null text counts as empty; letters A to Z fold to a to z and
nothing else does; a null doc_id stays only where its text has no other doc_id; of
rows that repeat both doc_id and text exactly one stays; an empty table gives no
rows; further columns are carried along and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm import bloom
from guardlake.llm.shared import packed, stage

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def normalised(text: Column) -> Column:
    """Null as empty, A-Z lowered. A text of single bytes only has no other letters, so ``lower`` does it there."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, UPPER.lower()))


def digest(text: Column) -> Column:
    return F.sha2(normalised(text), 256)


def _groups(maybe: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows per (text, id), and per text the id that stays and the size, written as a table of its own."""
    ids = maybe.groupBy("text_sha256", "doc_id").agg(F.count(F.lit(1)).alias("n"))
    groups = ids.groupBy("text_sha256").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    return ids, stage(groups, "groups")[0]


def decisions(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    keys, _ = stage(docs.select("doc_id", digest(docs["text"]).alias("text_sha256")), "hashes")
    tested = bloom.tested(keys, "text_sha256", bloom.repeated(keys, "text_sha256", keys.count()))
    alone = tested.filter(~F.col("maybe")).select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    ids, groups = _groups(tested.filter("maybe"))
    rows = ids.join(groups, "text_sha256").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    copies = rows.select("doc_id", "keep_id", "group_size",
                         (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "text_sha256")
    return alone.unionByName(copies)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents that stay, with their columns as they are. Texts shuffle by (text hash, id), so that copies spread."""
    keys, _ = stage(docs.select("doc_id", digest(docs["text"]).alias("text_sha256")), "hashes")
    filter_ = bloom.repeated(keys, "text_sha256", keys.count())
    filter_ = stage(filter_[0], "filter")[0], filter_[1]
    _, groups = _groups(bloom.tested(keys, "text_sha256", filter_).filter("maybe"))
    rows = bloom.tested(packed(docs, key=digest(docs["text"])), "key", filter_)
    stay = groups.select(F.col("text_sha256").alias("key"), "keep_id")
    copies = rows.filter("maybe").withColumn("id", F.col("doc.doc_id"))
    copies = copies.join(stay, (copies["key"] == stay["key"]) & copies["id"].eqNullSafe(stay["keep_id"]), "left_semi")
    copies = copies.dropDuplicates(["key", "id"])
    return rows.filter(~F.col("maybe")).select("doc.*").unionByName(copies.select("doc.*"))
