"""The registered queries of this package: each takes (spark, folder of the tables)."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from guardlake.llm import (
    exact_dedup, language_id, license_scan, lm_mixing, merkle, mixing, ngram_join, quality_rules, secret_scan, sentencepiece_codec, token_counts, turn_repair, warc,
)
from guardlake.llm.shared import fresh, table


def tokenizers() -> str:
    """Folder of the public tokenizers, the same on every machine."""
    return os.environ.get("GUARDLAKE_TOKENIZERS", "/opt/tokenizers")


def piece_model() -> str:
    return f"{tokenizers()}/piece_bpe_32k.model"


#: The pattern of the byte-level tokenizer, a fixed value.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    archives = fresh(spark, "warc")
    warc.write(table(spark, folder, "pages").select("page_id", "url", "html"), archives)
    return warc.pages_of(warc.records(spark, archives))


def op2_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    return secret_scan.report(table(spark, folder, "documents").select("doc_id", "text"))


def op3_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return exact_dedup.decisions(table(spark, folder, "documents").select("doc_id", "text"))


def op4_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    return license_scan.scan(table(spark, folder, "documents").select("doc_id", "text"))


def op5_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    return sentencepiece_codec.encode(table(spark, folder, "documents").select("doc_id", "text"), piece_model())


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    return language_id.report(table(spark, folder, "documents").select("doc_id", "text", "lang"))


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.report(table(spark, folder, "documents").select("doc_id", "text", "lang"), table(spark, folder, "labels"))


def op8_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Every document is counted, revised by three edits of its own, and counted again by them."""
    ranks = f"{tokenizers()}/byte_bpe_50k.tiktoken"
    docs = table(spark, folder, "documents").select("doc_id", "text", "source")
    docs = docs.withColumn("edits", token_counts.revision(docs["text"], docs["doc_id"], docs["source"]))
    trees = token_counts.build(docs, ranks, PATTERN, "doc_id", "text", "edits")
    return token_counts.recount(trees, ranks, PATTERN)


def op9_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(table(spark, folder, "documents").select("doc_id", "text", "source"))


def op10_ngram_join(spark: SparkSession, folder: str) -> DataFrame:
    return ngram_join.report(table(spark, folder, "documents").select("doc_id", "text"))


def op11_lm_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return lm_mixing.report(table(spark, folder, "documents").select("doc_id", "text"))


def op12_turn_repair(spark: SparkSession, folder: str) -> DataFrame:
    return turn_repair.report(table(spark, folder, "conversations"))


def op13_merkle(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select(*merkle.FIELDS)
    return merkle.manifest(docs, merkle.lowered(docs))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_warc, op2_secret_scan, op3_exact_dedup, op4_license_scan, op5_sentencepiece, op6_language_id, op7_quality_rules,
    op8_token_counts, op9_mixing, op10_ngram_join, op11_lm_mixing, op12_turn_repair, op13_merkle)}
