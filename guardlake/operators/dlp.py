"""Sensitive-data detection: counts, matches with context, rollups."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import dialect as X
from guardlake.functions.cache import remember
from guardlake.functions.rows import exploded, let, running_starts
from guardlake.operators.scan import capped, labels_from_flags


def points(severity: str) -> int:
    return C.SEVERITY_SCORE.get(severity, C.SEVERITY_SCORE_OTHER)


def _pattern(d: C.Detector) -> str:
    has_letters = any(c.isalpha() for c in d.text.replace(r"\d", "").replace(r"\s", "").replace(r"\b", ""))
    return X.java(d.text, ignore_case=has_letters)


@remember
def match_count(d: C.Detector, text: str = "content", low: str = "fold") -> Column:
    count = F.regexp_count(F.col(text), F.lit(_pattern(d)))
    cheap = X.holds_needed(F.col(low), d.needs)
    return F.coalesce(count if cheap is None else F.when(cheap, count), F.lit(0))


def with_counts(df: DataFrame, text: str = "content", detectors=C.DETECTORS) -> DataFrame:
    """Add one match count per detector (``n_<name>``)."""
    df = df.withColumn("fold", X.folded(F.col(text)))
    return df.withColumns({f"n_{d.name}": match_count(d, text) for d in detectors}).drop("fold")


def _total(detectors, weight=lambda d: 1) -> Column:
    terms = [F.col(f"n_{d.name}") * weight(d) for d in detectors]
    return reduce(lambda a, b: a + b, terms) if terms else F.lit(0)


@remember
def _score_parts(detectors) -> dict[str, Column]:
    return {
        "dlp_points": _total(detectors, lambda d: points(d.severity)),
        "match_count": _total(detectors),
        "critical_count": _total([d for d in detectors if d.severity == "critical"]),
        "high_count": _total([d for d in detectors if d.severity == "high"]),
        **{f"dlp_{label}": (_total([d for d in detectors if d.category == label]) > 0).cast("int")
           for label in C.DLP_LABELS}}


def score_columns(df: DataFrame, detectors=C.DETECTORS) -> DataFrame:
    """Uncapped score, counts and one flag per label from the ``n_`` columns, which are dropped."""
    return df.withColumns(_score_parts(detectors)).drop(*[f"n_{d.name}" for d in detectors])


def matches(df: DataFrame, text: str = "content", keys=("conv_id", "turn"), detectors=C.DETECTORS,
            preview: bool = False) -> DataFrame:
    """One row per match: category, severity, detector, position in the detector's match list.

    With ``preview`` each row carries the match with twenty characters on either
    side.  Offsets come from the text between the matches (``split``) and the
    match lengths; previews are cut inside the row, so the text is not copied to
    the matches.
    """
    df = df.withColumn("fold", X.folded(F.col(text)))

    def spots(d: C.Detector, got: Column) -> Column:
        if not preview:
            return got
        gaps = F.transform(F.slice(F.split(F.col(text), _pattern(d), -1), 1, F.size(got)), F.char_length)

        def placed(starts: Column) -> Column:
            return F.transform(got, lambda m, i: let(F.get(starts, i), lambda at: F.struct(
                m.alias("matched"), at.alias("match_start"), _around(F.col(text), at, F.char_length(m)).alias("evidence_preview"))))

        def started(sizes: Column) -> Column:
            steps = F.zip_with(sizes, got, lambda g, m: g + F.char_length(m))
            return let(F.zip_with(running_starts(steps), sizes, lambda s, g: s + g), placed)

        return let(gaps, started)

    def found(d: C.Detector) -> Column:
        cheap = X.holds_needed(F.col("fold"), d.needs)
        of = lambda got: F.when(F.size(got) > 0, F.struct(
            F.lit(d.category).alias("category"), F.lit(d.severity).alias("severity"), F.lit(d.name).alias("pattern_name"), spots(d, got).alias("found")))
        rows = let(F.regexp_extract_all(F.col(text), F.lit(_pattern(d)), F.lit(0)), of)
        return rows if cheap is None else F.when(cheap, rows)

    per_detector = exploded(df, list(keys), F.array_compact(F.array(*[found(d) for d in detectors])), "d")
    rows = per_detector.select(*keys, "d.category", "d.severity", "d.pattern_name", F.posexplode("d.found").alias("match_pos", "matched"))
    return rows.select(*keys, "category", "severity", "pattern_name", "match_pos", "matched.*") if preview else rows


def _around(text: Column, start: Column, size: Column) -> Column:
    """A match with its margins, line feeds as blanks, at the preview's length."""
    left = F.greatest(F.lit(0), start - C.PREVIEW_MARGIN)
    around = F.substring(text, left + 1, start + size + C.PREVIEW_MARGIN - left)
    return F.substring(F.replace(around, F.lit("\n"), F.lit(" ")), 1, C.PREVIEW_CHARS)


def rollup(df: DataFrame, key: str, text: str = "content", detectors=C.DETECTORS) -> DataFrame:
    """Score, labels and counts per key; texts become integers before the shuffle."""
    return combine(score_columns(with_counts(df, text, detectors), detectors), key)


def combine(scored: DataFrame, key: str) -> DataFrame:
    summed = scored.groupBy(key).agg(
        F.sum("dlp_points").alias("points"), F.sum("match_count").alias("match_count"),
        F.sum("critical_count").alias("critical_count"), F.sum("high_count").alias("high_count"),
        *[F.max(f"dlp_{n}").alias(f"dlp_{n}") for n in C.DLP_LABELS])
    return summed.select(key, capped("points").alias("dlp_score"),
                         labels_from_flags(C.DLP_LABELS, "dlp_").alias("dlp_labels"),
                         "match_count", "critical_count", "high_count")


def metadata_text(name: str, content_type: str, uri: str) -> Column:
    return F.concat_ws(" " + chr(124) + " ", *[F.coalesce(F.col(c), F.lit("")) for c in (name, content_type, uri)])


def corpus_profile(df: DataFrame, dims: list[str], text: str = "text", doc: str = "doc_id",
                   detectors=C.DETECTORS) -> DataFrame:
    """Matches and documents (rows of the table) per detector and dimension.

    Counts per document first; the detectors unpivot after the texts are gone.
    """
    counted = with_counts(df, text, detectors).select(doc, *dims, *[f"n_{d.name}" for d in detectors])
    long = counted.select(doc, *dims, F.explode(F.array(*[
        F.struct(F.lit(d.name).alias("detector"), F.col(f"n_{d.name}").alias("n")) for d in detectors])).alias("x"))
    return (long.filter("x.n > 0").groupBy(*dims, F.col("x.detector").alias("detector"))
            .agg(F.sum("x.n").alias("matches"), F.count(F.lit(1)).alias("documents")))
