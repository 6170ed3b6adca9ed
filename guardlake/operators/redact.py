"""Ordered redaction and the checks that follow it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import dialect as X
from guardlake.functions.cache import remember
from guardlake.functions.rows import let
from guardlake.operators import dlp


def _step(rule: C.Rewrite) -> tuple[str, str]:
    mark = ("$1$2" if rule.keep else "") + rule.mark
    return X.java(rule.text, rule.ignore_case), mark


@remember
def _rewritten(text: str, fold: str, rules, counted: bool) -> Column:
    """The whole chain as one expression over a (text, count) pair; each step binds its input once."""
    state = F.struct(F.col(text).alias("t"), F.lit(0).alias("n"))
    for rule in rules:
        pattern, mark = _step(rule)
        cheap = X.holds_needed(F.col(fold), rule.needs)

        def step(s):  # used at once, so it may read the loop variables
            n = s["n"] + F.regexp_count(s["t"], F.lit(pattern)) if counted else s["n"]
            done = F.struct(F.regexp_replace(s["t"], pattern, mark).alias("t"), n.alias("n"))
            return done if cheap is None else F.when(cheap, done).otherwise(s)
        state = let(state, step)
    return state


def redact(df: DataFrame, text: str, out: str | None = None, count: str | None = None,
           rules=C.PROMPT_REWRITES) -> DataFrame:
    """Apply the rewrites in order; optionally count the replacements.

    A text without the literals a rule needs skips it; the literals are looked up
    in the original text, because a mark ends in a bracket and so never completes
    a keyword for a later rule.
    """
    df = df.withColumn("_fold", X.folded(F.col(text)))
    df = df.withColumn("_s", _rewritten(text, "_fold", rules, bool(count)))
    done = {out or text: F.col("_s.t")}
    if count:
        done[count] = F.coalesce("_s.n", F.lit(0))
    return df.withColumns(done).drop("_s", "_fold")


def redact_output(text: Column) -> Column:
    """Secrets in an answer (five steps)."""
    for rule in C.OUTPUT_REWRITES:
        pattern, mark = _step(rule)
        text = F.regexp_replace(text, pattern, mark)
    return text


def redact_leaks(text: Column) -> Column:
    """Prompt-leak phrases in an answer."""
    for phrase in C.OUTPUT_LEAK_PHRASES:
        text = F.regexp_replace(text, X.java(phrase, ignore_case=True), C.OUTPUT_LEAK_MARK)
    return text


def residual(df: DataFrame, text: str, keys: list[str]) -> DataFrame:
    """Per key: sensitive matches left in the text whose surroundings hold no redaction mark,
    and their detector names in first-seen order."""
    left = (dlp.matches(df, text, keys, preview=True)
            .filter(F.col("category").isin(*C.SENSITIVE_CATEGORIES))
            .filter(~F.contains("evidence_preview", F.lit("[REDACTED_"))))
    order = {d.name: i for i, d in enumerate(C.DETECTORS)}
    position = F.create_map(*[F.lit(x) for pair in order.items() for x in pair])[F.col("pattern_name")]
    # at most one entry per detector and key, whatever the number of matches
    per_name = left.groupBy(*keys, "pattern_name").agg(F.count(F.lit(1)).alias("n"))
    names = F.transform(F.array_sort(F.collect_list(F.struct(position.alias("p"), "pattern_name"))), lambda s: s["pattern_name"])
    return per_name.groupBy(*keys).agg(F.sum("n").alias("residual_count"), names.alias("residual_patterns"))


def with_residual_count(df: DataFrame, text: str, out: str = "residual_count") -> DataFrame:
    """The count of ``residual`` as a column of the row, without a shuffle."""
    df = df.withColumn("_fold", X.folded(F.col(text)))
    total = F.lit(0)
    for d in C.DETECTORS:
        if d.category not in C.SENSITIVE_CATEGORIES:
            continue
        pattern = X.java(d.text, ignore_case=True)
        cheap = X.holds_needed(F.col("_fold"), d.needs)
        n = _unmarked(F.col(text), pattern)
        total = total + (n if cheap is None else F.when(cheap, n).otherwise(0))
    return df.withColumn(out, total).drop("_fold")


def _unmarked(text: Column, pattern: str) -> Column:
    """Matches without a redaction mark within the preview.

    Matches and the gaps before them are bound once and walked once, with the place carried along.
    """
    def clean(start: Column, size: Column) -> Column:
        left = F.greatest(F.lit(0), start - C.PREVIEW_MARGIN)
        preview = F.substring(F.substring(text, left + 1, start + size + C.PREVIEW_MARGIN - left), 1, C.PREVIEW_CHARS)
        return (~F.contains(preview, F.lit("[REDACTED_"))).cast("int")

    def walked(steps: Column) -> Column:
        step = lambda s, p: let(s["at"] + p["gap"], lambda start: F.struct(
            (start + p["size"]).alias("at"), (s["n"] + clean(start, p["size"])).alias("n")))
        return F.aggregate(steps, F.struct(F.lit(0).alias("at"), F.lit(0).alias("n")), step, lambda s: s["n"])

    def paired(found: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
        steps = F.zip_with(gaps, found, lambda g, m: F.struct(F.char_length(g).alias("gap"), F.char_length(m).alias("size")))
        return F.when(F.size(found) > 0, let(steps, walked)).otherwise(0)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), paired)


def failsafe(df: DataFrame, text: str) -> DataFrame:
    """Redact only texts that still hold sensitive matches; report whether they changed."""
    df = with_residual_count(df, text)
    df = redact(df.withColumn("_open", F.when(F.col("residual_count") > 0, F.col(text))), "_open", "_masked")
    return (df.withColumn("was_redacted", F.coalesce(F.col("_masked") != F.col(text), F.lit(False)))
            .withColumn(text, F.coalesce("_masked", F.col(text)))
            .drop("_open", "_masked"))


def redaction_counts(df: DataFrame, kind: str, text: str, skip: Column | None = None) -> DataFrame:
    """Rows of each kind and how many the fail-safe redaction changed; rows to skip never change."""
    shown = df.filter(F.btrim(F.col(text)) != "")
    if skip is not None:
        shown = shown.filter(~skip)
    return (failsafe(shown, text).groupBy(kind)
            .agg(F.count(F.lit(1)).alias("seen"), F.count_if("was_redacted").alias("redacted")))
