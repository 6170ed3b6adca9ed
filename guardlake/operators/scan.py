"""Input threat scan: one pass over each text, signals as an array column."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import dialect as X
from guardlake.functions import text as T
from guardlake.functions.cache import remember
from guardlake.functions.rows import exploded, let


def _signal(category: str, severity: str, weight: int, pattern: str) -> Column:
    return F.struct(F.lit(category).alias("category"), F.lit(severity).alias("severity"),
                    F.lit(weight).alias("weight"), F.lit(pattern).alias("pattern"))


def with_lowered(df: DataFrame, text: str = "content") -> DataFrame:
    """Lower-cased text and its folded form for the literal tests, computed once."""
    return df.withColumn("low", F.lower(text)).withColumn("fold", X.unfolded(F.col("low")))


@remember
def hit(family: C.Family, pattern: C.Pattern, text: str = "content") -> Column:
    """Does the pattern occur?

    Patterns that ignore case run in lower case on the folded text: the same
    matches as case folding inside the matcher, at a fraction of its cost.
    """
    if family.ignore_case:
        if re.search(r"\\[A-Z]", pattern.finder):
            raise ValueError(f"{pattern.finder}: classes in capitals would turn into their opposite in lower case")
        test = F.col("fold").rlike(X.java(pattern.finder.lower()))
    else:
        test = F.col("low" if family.lowered else text).rlike(X.java(pattern.finder))
    return X.gated(F.col("fold"), pattern.needs, test)


@remember
def family_hit(family: C.Family, text: str = "content") -> Column:
    """Does any pattern of the family occur?"""
    if family.any_of:
        # Character classes: one class for all, behind a single range that plain
        # Latin text never enters (every listed character lies above its start).
        return F.col(text).rlike(r"[\u0301-\uFFFF]") & F.col(text).rlike("[" + "".join(p.finder for p in family.patterns) + "]")
    return reduce(lambda a, b: a | b, [hit(family, p, text) for p in family.patterns])


@remember
def family_signals(family: C.Family, text: str = "content") -> Column:
    """Signals of one family as an array column (needs the ``with_lowered`` columns)."""
    if family.any_of:
        tests = [F.when(family_hit(family, text),
                        _signal(family.category, family.severity, family.weight, family.any_of))]
    else:
        tests = [F.when(hit(family, p, text), _signal(family.category, family.severity, family.weight, p.text))
                 for p in family.patterns]
    return F.array_compact(F.array(*tests))


# --- nested encodings -----------------------------------------------------

_TOKEN_MARK = "\u0001"


def _utf8_lenient(raw: Column) -> Column:
    """Bytes to text, dropping what is not valid UTF-8.

    A replacement character that is really in the bytes becomes a control
    character first (it is as undecodable as the original in the next layer),
    so that only the marks set for bad bytes are dropped.
    """
    kept = F.replace(raw.cast("string"), F.lit("�"), F.lit(_TOKEN_MARK))
    return F.replace(F.make_valid_utf8(kept), F.lit("�"), F.lit(""))


@remember
def _peel(name: str) -> Column:
    return let(F.col(name), _one_layer)


def _one_layer(layer: Column) -> Column:
    """Text one layer down, or null: strict base64 first, then hexadecimal pairs."""
    tail = F.substring(layer, -4, 4)
    is_b64 = (F.char_length(layer) % 4 == 0) & layer.rlike("^[A-Za-z0-9+/]+={0,2}$") & ~tail.rlike("^=")
    b64 = F.when(is_b64, _utf8_lenient(F.try_to_binary(layer, F.lit("base64"))))
    pairs = F.split(layer, "[ \\t\\n\\r\\f\\x0b]+")
    is_hex = layer.rlike("^[0-9A-Fa-f \\t\\n\\r\\f\\x0b]+$") & F.forall(pairs, lambda p: F.char_length(p) % 2 == 0)
    hexed = F.when(is_hex, _utf8_lenient(F.unhex(F.array_join(pairs, ""))))
    deep = lambda got: F.when((got != layer) & (F.char_length(got) > C.NESTED_MIN_CHARS), got)
    return T.strip(F.coalesce(let(b64, deep), let(hexed, deep)))


def may_be_encoded(text: Column) -> Column:
    """Cheap whole-text test: nothing but base64 letters, or nothing but hex and blanks."""
    return text.rlike("^\\s*(?:[A-Za-z0-9+/]{15,}={0,2}|[0-9A-Fa-f \\t\\n\\r\\f\\x0b]{22,})\\s*$")


def encoding_depth(df: DataFrame, text: str = "content", out: str = "nested_depth") -> DataFrame:
    """Add how many encoding layers the text has (0 to 3); built-in functions only."""
    plain = F.col(text)
    df = df.withColumn("_l0", F.when(may_be_encoded(plain), T.strip(plain)))
    for i in range(C.NESTED_MAX_LAYERS):
        df = df.withColumn(f"_l{i + 1}", _peel(f"_l{i}"))
    layers = [F.col(f"_l{i + 1}").isNotNull().cast("int") for i in range(C.NESTED_MAX_LAYERS)]
    return (df.withColumn(out, reduce(lambda a, b: a + b, layers))
            .drop(*[f"_l{i}" for i in range(C.NESTED_MAX_LAYERS + 1)]))


# --- all families ---------------------------------------------------------

def with_signals(df: DataFrame, text: str = "content", families=C.FAMILIES, nested: bool = True) -> DataFrame:
    """Add ``signals``: every hit of every family, in reporting order."""
    df = with_lowered(df, text)
    arrays = [family_signals(f, text) for f in families]
    if nested:
        df = encoding_depth(df, text)
        mark = _signal(C.NESTED_CATEGORY, C.NESTED_SEVERITY, C.NESTED_WEIGHT, C.NESTED_NAME)
        arrays.insert(0, F.array_compact(F.array(F.when(F.col("nested_depth") >= C.NESTED_MIN_LAYERS, mark))))
    df = df.withColumn("signals", F.concat(*arrays))
    return df.drop("low", "fold", "nested_depth")


def leak_label(pattern: Column) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(pattern, F.lit(p)) for p in C.LEAK_PHRASES])


def signals_long(df: DataFrame, text: str = "content", keys=("conv_id", "turn"), **kw) -> DataFrame:
    """One row per (text, pattern) hit, with the first characters as evidence."""
    found = with_signals(df, text, **kw)
    return (exploded(found, [*keys, F.substring(text, 1, C.EVIDENCE_CHARS).alias("evidence")], "signals", "s")
            .select(*keys, "s.category", "s.severity", "s.weight", "s.pattern", "evidence"))


@remember
def _score_parts(signals: str) -> dict[str, Column]:
    has = lambda label: (F.exists(signals, lambda s: leak_label(s["pattern"])
                                  & (s["category"] == "prompt_injection")) if label == C.LEAK_LABEL
                         else F.exists(signals, lambda s: s["category"] == label))
    return {"scan_points": F.aggregate(signals, F.lit(0), lambda acc, s: acc + s["weight"]),
            "signal_count": F.size(signals),
            **{f"is_{label}": has(label).cast("int") for label in C.INPUT_LABELS}}


def score_columns(df: DataFrame, signals: str = "signals") -> DataFrame:
    """Uncapped score, signal count and one flag per label from the signal array."""
    return df.withColumns(_score_parts(signals))


@remember
def labels_from_flags(labels, prefix: str = "is_") -> Column:
    """Sorted label array from 0/1 columns (the label list is already sorted)."""
    return F.array_compact(F.array(*[F.when(F.col(f"{prefix}{name}") > 0, name) for name in labels]))


def capped(points) -> Column:
    return F.least(F.lit(C.SCORE_CAP), F.col(points) if isinstance(points, str) else points).cast("int")


def rollup(df: DataFrame, key: str, text: str = "content", **kw) -> DataFrame:
    """Capped score, sorted labels and signal count per key; clean keys give 0 and no labels.

    Texts become a few integers before the shuffle, and the sums combine on the
    map side, so a key with very many messages costs one small row per task.
    """
    scored = score_columns(with_signals(df, text, **kw)).select(
        key, "scan_points", "signal_count", *[f"is_{n}" for n in C.INPUT_LABELS])
    return (scored.groupBy(key)
            .agg(F.sum("scan_points").alias("points"), F.sum("signal_count").alias("signal_count"),
                 *[F.max(f"is_{n}").alias(f"is_{n}") for n in C.INPUT_LABELS])
            .select(key, capped("points").alias("input_score"),
                    labels_from_flags(C.INPUT_LABELS).alias("input_labels"), "signal_count"))


def family_prefilter(df: DataFrame, text: str = "content", families=C.FAMILIES) -> DataFrame:
    """Rows that hold the literals of at least one pattern of each family, as flags ``may_<family>``."""
    df = with_lowered(df, text)
    flags = {}
    for family in families:
        tests = [X.holds_needed(F.col("fold"), p.needs) for p in family.patterns]
        # a pattern without needed literals can only be ruled out by running it
        tests = [t if t is not None else hit(family, p, text) for t, p in zip(tests, family.patterns)]
        flags[f"may_{family.key}"] = reduce(lambda a, b: a | b, tests)
    return df.withColumns(flags).drop("low", "fold")
