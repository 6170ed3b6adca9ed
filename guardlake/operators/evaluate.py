"""Evaluation: labelled payloads, detector quality, corpus scans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import scan


def regression(pack: DataFrame, text: str = "payload", expected: str = "expected_label") -> DataFrame:
    """Recall per expected label: was it among the labels of the text?"""
    scored = scan.score_columns(scan.with_signals(pack, text))
    labels = scan.labels_from_flags(C.INPUT_LABELS)
    found = scored.select(expected, F.array_contains(labels, F.col(expected)).alias("found"),
                          (F.col("scan_points") > 0).alias("scored"))
    return (found.groupBy(expected).agg(F.count(F.lit(1)).alias("payloads"), F.count_if("found").alias("found"),
                                        F.count_if("scored").alias("scored"))
            .withColumn("recall", F.round(F.col("found") / F.col("payloads"), 6)))


def quality(verdicts: DataFrame, labels: DataFrame, key: str = "doc_id", truth: str = "toxic") -> DataFrame:
    """Confusion counts, precision and recall of ``flagged`` against a 0/1 label."""
    both = verdicts.select(key, "flagged").join(labels.select(key, truth), key)
    hit, real = F.col("flagged"), F.col(truth) == 1
    counts = both.agg(F.count(F.lit(1)).alias("judged"), F.count_if(hit & real).alias("tp"), F.count_if(hit & ~real).alias("fp"),
                      F.count_if(~hit & real).alias("fn"), F.count_if(~hit & ~real).alias("tn"))
    ratio = lambda a, b: F.round(F.when(b > 0, a / b), 6)
    return (counts.withColumn("precision", ratio(F.col("tp"), F.col("tp") + F.col("fp")))
            .withColumn("recall", ratio(F.col("tp"), F.col("tp") + F.col("fn"))))


def corpus_scan(df: DataFrame, dims: list[str], text: str = "text") -> DataFrame:
    """Signals per dimension with subtotals; texts are gone before the shuffle."""
    scored = scan.score_columns(scan.with_signals(df, text)).select(*dims, "scan_points", "signal_count")
    fine = scored.groupBy(*dims).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col("signal_count") > 0).alias("f"),
        F.sum("signal_count").alias("s"), F.max(scan.capped("scan_points")).alias("m"))
    return fine.rollup(*dims).agg(
        F.sum("n").alias("texts"), F.sum("f").alias("flagged"), F.sum("s").alias("signals"),
        F.max("m").alias("max_score"), F.grouping_id().cast("int").alias("level"))


def riskiest(df: DataFrame, key: str, text: str = "text", n: int = 20) -> DataFrame:
    """Texts with the highest score (a top-n report)."""
    scored = scan.score_columns(scan.with_signals(df, text))
    return (scored.select(key, scan.capped("scan_points").alias("score"), "signal_count")
            .orderBy(F.desc("score"), F.desc("signal_count"), key).limit(n))
