"""A corpus from raw documents to tokens, in five stages; each is written as Parquet and read again for the next.

An empty table, or one whose documents all go, gives an empty table at each stage; without
labels the quality stage only applies its base rule. Texts of any length are whole in every
stage. The tables that a stage stages on its way are removed when the next one begins, unless
that one's documents still read them (they do not once they are written and read again).
"""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, SparkSession

from guardlake.llm import exact_dedup, mixing, ngram_join, quality_rules, sentencepiece_codec
from guardlake.llm.queries import piece_model
from guardlake.llm.shared import drop, reads, scope, stage, table

#: What the stage before has staged.
_left: list[str] = []


def _tidy(step):
    @functools.wraps(step)
    def run_step(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        if not reads(docs, _left):
            drop(spark, *_left)
        _left.clear()
        with scope(_left):
            return step(spark, docs, sf_dir)
    return run_step


@_tidy
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rule or a certified cutoff rejects go."""
    return quality_rules.filtered(docs, table(spark, sf_dir, "labels"))


@_tidy
def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the document with the largest doc_id stays."""
    return exact_dedup.deduplicated(docs)


@_tidy
def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of near-duplicates the document with the least doc_id stays."""
    return ngram_join.one_of_each(docs)


@_tidy
def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeat or go so that their sources meet their targets."""
    return mixing.mixed(docs)


@_tidy
def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Piece ids of every document of the mix."""
    return sentencepiece_codec.encode(docs, piece_model())


STAGES = [("quality_rules", quality), ("exact_dedup", exact), ("ngram_join", near), ("mixing", mix), ("sentencepiece", tokens)]

#: The cutoffs of the rules, MinHash and the tokens are beyond SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), None
    for name, step in STAGES[:-1]:
        docs, path = stage(step(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            drop(spark, before)
        before = path
    return STAGES[-1][1](spark, docs, sf_dir)
