"""Secrets in texts: three fixed kinds, and long tokens that pass a battery of randomness tests.

Fixed kinds are regular expressions whose matches must be long enough. Beside them,
every token of 20 characters or more over letters, digits, ``+/_-`` is tested:

1. Its encoding is the smallest alphabet that holds it (hex, base 32, 36, 62, 64).
2. Three tests hold it against uniform random symbols of that alphabet: chi-squared of
   the symbol counts, number of runs above and below the middle symbol, and serial
   correlation of neighbours. It passes if the least of the three p-values, times
   three, is at least ``alpha``: a random token fails with at most that chance.
3. Its score is the log likelihood ratio of random symbols against ordinary text: pairs
   of neighbouring symbols as counted in all words of up to 19 characters of all documents,
   letters in either case, held to the token's alphabet; and seldom changes of case. One
   part in fifty of ordinary text is taken as random, so no pair weighs more than log 50.
4. Its p-value as an ordinary token is twice the lesser of two. One is the chance that
   symbols of ordinary text repeat as seldom as seen (coincidence index, normal tail). The
   other is the chance of such a score: at most e^-score for text like the counted words,
   and not less than the normal tail above the mean and spread of the tokens of the band
   whose score is not above 0, where there are 30 of them. Without words to count from,
   scores say little and the first remains.
   A token that the battery fails has p-value 1.
5. Tokens of like length form a band; in each band the Benjamini-Hochberg rule over all
   tokens of all documents that could be added (none that overlaps a fixed match) picks the p-values to accept, at false-discovery rate
   ``rate``. P-values are counted in bins of e^(1/20) and take their bin's upper edge,
   so the ranking is a small table however many tokens there are.

A token that overlaps a fixed match is not added. Positions are code points, end
exclusive. A null text counts as empty and has no spans; rows are independent, so
repeated rows give repeated results; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.shared import let, running_starts, stage

#: The kinds in the order of the result, their pattern, the group that is measured, its least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]+", 0, 20),
    ("hex", r"[0-9a-f]+", 0, 24),
)
#: A cheap test that every text with a match of the kind passes.
GATES = (r"(?i:password|passwd|secret|token|api_?key)", "AKIA", "[0-9a-f]{24}")
TOKEN, TOKEN_GATE = r"[A-Za-z0-9+/_-]{20,}", r"[A-Za-z0-9+/_-]{20}"
RANDOM = 3

#: Encodings from the smallest alphabet up: what it matches, its symbols in order, and the coincidence index
#: of ordinary tokens over it (natural language has about 0.066; for hex, runs of digits or of few letters). ``-_`` are read as ``+/``.
ENCODINGS = (
    ("[0-9a-f]+", "0123456789abcdef", 0.11),
    ("[0-9A-F]+", "0123456789ABCDEF", 0.11),
    ("[A-Z2-7]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 0.066),
    ("[0-9a-z]+", "0123456789abcdefghijklmnopqrstuvwxyz", 0.066),
    ("[0-9A-Za-z]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", 0.066),
    ("[0-9A-Za-z+/_-]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 0.066),
)
#: Lengths at which a new band begins.
BANDS = (20, 24, 32, 40, 48, 64, 96, 128)
BINS_PER_E, LAST_BIN = 20, 4000

SPAN = "array<struct<start:int,kind:int,end:int>>"
TOKENS = "array<struct<start:int,end:int,band:int,p:double,score:long,passes:boolean>>"
#: Scores are whole thousandths.
MILLI = 1000
#: Part of ordinary text taken as random; counts that the frequencies of single symbols, and random symbols, weigh as much as.
RANDOM_PART, BACKOFF = 0.02, 50
#: Chance that neighbouring letters of an ordinary token differ in case.
SWITCH = 0.1
#: Tokens of a band needed to measure its ordinary scores, and the least spread (a symbol's score) taken for them.
MEASURED, LEAST_SPREAD = 30, 0.05


def found(text: Column, pattern: str, group: int, least: int, gate: str, kind: int) -> Column:
    """Spans of the matches whose group is long enough: gaps between matches and their lengths give the places."""
    def spans(hits: Column) -> Column:
        gaps = F.transform(F.split(text, pattern, -1), F.length)
        sizes = F.transform(hits, F.length)
        steps = F.zip_with(gaps, sizes, lambda g, s: F.coalesce(g, F.lit(0)) + F.coalesce(s, F.lit(0)))
        measured = sizes if group == 0 else F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.length)
        starts = F.zip_with(running_starts(steps), gaps, lambda a, g: a + g)
        sized = F.zip_with(sizes, measured, lambda a, b: F.struct(a.alias("size"), b.alias("measured")))
        rows = F.zip_with(starts, sized, lambda at, m: F.struct(
            at.alias("start"), F.lit(kind).alias("kind"), (at + m["size"]).alias("end"), m["measured"].alias("measured")))
        long_enough = F.filter(rows, lambda r: r["measured"] >= least)
        return F.transform(long_enough, lambda r: F.struct(r["start"], r["kind"], r["end"])).cast(SPAN)

    hits = F.when(text.rlike(gate), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), spans))
    return F.coalesce(hits, F.array().cast(SPAN))


def tail(z: Column) -> Column:
    """Chance that a standard normal exceeds z (relative error below 2e-7 on either side)."""
    def upper(x: Column) -> Column:
        t = 1 / (1 + x / 2)
        terms = (1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)
        poly = F.lit(terms[-1])
        for c in reversed(terms[:-1]):
            poly = poly * t + c
        return t * F.exp(-x * x - 1.26551223 + t * poly) / 2

    return let(z / 2 ** 0.5, lambda x: let(upper(F.abs(x)), lambda u: F.when(x >= 0, u).otherwise(1 - u)))


def pairs(docs: DataFrame) -> dict[str, int]:
    """How often symbols follow each other in the words of 2 to 19 symbols, letters lower-cased: one count per pair of symbols."""
    words = docs.select(F.explode(F.split("text", "[^A-Za-z0-9+/_-]+")).alias("word")).filter("length(word) BETWEEN 2 AND 19")
    each = words.groupBy("word").agg(F.count(F.lit(1)).alias("n"))
    plain = F.translate(F.lower("word"), "-_", "+/")
    at = each.select(plain.alias("word"), "n", F.explode(F.sequence(F.lit(1), F.length("word") - 1)).alias("at"))
    counted = at.groupBy(F.substring("word", F.col("at"), F.lit(2)).alias("pair")).agg(F.sum("n").alias("n"))
    return {r["pair"]: r["n"] for r in counted.collect()}  # at most 38 * 38


def folded(alphabet: str) -> str:
    """The alphabet's symbols without case."""
    return "".join(dict.fromkeys(alphabet.lower()))


def scores(counts: dict[str, int], alphabet: str) -> list[int]:
    """Per pair of folded symbols (first times their number plus second): log of random over ordinary, given the first."""
    symbols = folded(alphabet)
    random = [sum(c.lower() == s for c in alphabet) / len(alphabet) for s in symbols]
    rows = [[counts.get(a + b, 0) for b in symbols] for a in symbols]
    total = sum(map(sum, rows))
    single = [(sum(row[j] for row in rows) + BACKOFF * r) / (total + BACKOFF) for j, r in enumerate(random)]
    out = []
    for row in rows:
        seen = sum(row)
        for n, one, r in zip(row, single, random):
            ordinary = (1 - RANDOM_PART) * (n + BACKOFF * one) / (seen + BACKOFF) + RANDOM_PART * r
            out.append(round(MILLI * math.log(r / ordinary)))
    return out


def _score(token: Column, alphabet: str, table: list[int]) -> Column:
    """Log likelihood ratio of the token as random symbols over it as ordinary text."""
    symbols = folded(alphabet)
    weights = F.split(F.lit(",".join(map(str, table))), ",").cast("array<int>")
    plain = F.filter(F.split(F.translate(F.lower(token), "-_", "+/"), ""), lambda c: c != "")
    by_pair = let(F.transform(plain, lambda c: F.instr(F.lit(symbols), c) - 1), lambda index: F.aggregate(
        F.sequence(F.lit(1), F.size(index) - 1), F.lit(0).cast("long"),
        lambda s, i: s + F.get(weights, F.get(index, i - 1) * len(symbols) + F.get(index, i))))
    if len(symbols) == len(alphabet):
        return by_pair
    both = F.regexp_count(token, F.lit("[A-Za-z](?=[A-Za-z])"))
    switched = F.regexp_count(token, F.lit("[a-z](?=[A-Z])|[A-Z](?=[a-z])"))
    return by_pair + switched * round(MILLI * math.log(0.5 / SWITCH)) + (both - switched) * round(MILLI * math.log(0.5 / (1 - SWITCH)))


def _battery(token: Column, n: Column, alphabet: str, ordinary: float, alpha: float, table: list[int]) -> Column:
    """Whether the token may be random over the alphabet, its p-value by coincidence index, and its score."""
    k = len(alphabet)

    def judged(index: Column) -> Column:
        squares = F.aggregate(F.sequence(F.lit(0), F.lit(k - 1)), F.lit(0.0), lambda s, a: s + F.pow(
            F.size(F.filter(index, lambda v: v == a)).cast("double"), 2.0))
        chi = (squares * k / n - n - (k - 1)) / F.sqrt(2.0 * (k - 1) * (n - 1) / n)
        high = F.size(F.filter(index, lambda v: v >= k // 2)).cast("double")
        runs = 1.0 + F.aggregate(F.sequence(F.lit(1), F.size(index) - 1), F.lit(0), lambda s, i: s + F.when(
            (F.get(index, i) >= k // 2) != (F.get(index, i - 1) >= k // 2), 1).otherwise(0))
        mean = F.aggregate(index, F.lit(0.0), lambda s, v: s + v) / n
        moment = let(mean, lambda m: F.struct(
            F.aggregate(index, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)).alias("own"),
            F.aggregate(F.sequence(F.lit(1), F.size(index) - 1), F.lit(0.0), lambda s, i: s + (F.get(index, i) - m) * (
                F.get(index, i - 1) - m)).alias("next")))
        serial = let(moment, lambda m: F.when(m["own"] > 0, (m["next"] / m["own"] + 1 / n) * F.sqrt(n)).otherwise(99.0))

        def by_runs(h: Column) -> Column:
            mu = 2 * h * (n - h) / n + 1
            var = (mu - 1) * (mu - 2) / (n - 1)
            return F.when(var > 0, (runs - mu) / F.sqrt(F.greatest(var, F.lit(1e-9)))).otherwise(99.0)

        least = F.least(tail(chi), 2 * tail(F.abs(let(high, by_runs))), 2 * tail(F.abs(serial)))
        index_of = (squares - n) / (n * (n - 1))
        cubes = ordinary * ordinary * 1.3
        spread = F.sqrt(4 * (cubes - ordinary * ordinary) / n + 2 * (ordinary - ordinary * ordinary) / (n * (n - 1)))
        return F.struct((3 * least >= alpha).alias("passes"), tail((F.lit(ordinary) - index_of) / spread).alias("p"),
                        _score(token, alphabet, table).alias("score"))

    symbols = F.filter(F.split(F.translate(token, "-_", "+/"), ""), lambda c: c != "")
    return let(F.transform(symbols, lambda c: F.instr(F.lit(alphabet), c) - 1), judged)


def _tokens(text: Column, alpha: float, counts: dict[str, int]) -> Column:
    """Every long token with its place, band, p-value by coincidence index, score, and whether it may be random."""
    tables = [scores(counts, alphabet) for _, alphabet, _ in ENCODINGS]

    def tested(start: Column, token: Column) -> Column:
        n = F.length(token).cast("double")
        verdict = F.when(F.lit(False), F.lit(None).cast("struct<passes:boolean,p:double,score:long>"))
        for (pattern, alphabet, ordinary), table in zip(ENCODINGS, tables):
            verdict = verdict.when(token.rlike(f"^{pattern}$"), _battery(token, n, alphabet, ordinary, alpha, table))
        band = sum((F.when(F.length(token) >= b, 1).otherwise(0) for b in BANDS[1:]), F.lit(0))
        return let(verdict, lambda v: F.struct(start.alias("start"), (start + F.length(token)).alias("end"), band.alias("band"),
                                               v["p"].alias("p"), v["score"].alias("score"), v["passes"].alias("passes")))

    def placed(hits: Column) -> Column:
        gaps = F.transform(F.split(text, TOKEN, -1), F.length)
        steps = F.zip_with(gaps, hits, lambda g, h: F.coalesce(g, F.lit(0)) + F.coalesce(F.length(h), F.lit(0)))
        starts = F.zip_with(running_starts(steps), gaps, lambda a, g: a + g)
        rows = F.zip_with(starts, hits, lambda at, h: F.struct(at.alias("at"), h.alias("token")))
        mixed = F.filter(rows, lambda r: r["token"].isNotNull() & ~r["token"].rlike("^[0-9_-]+$|^[+/_-]+$"))
        return F.transform(mixed, lambda r: tested(r["at"], r["token"]))

    hits = F.when(text.rlike(TOKEN_GATE), let(F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0)), placed))
    return F.coalesce(hits.cast(TOKENS), F.array().cast(TOKENS))


def ordinary_scores(tokens: DataFrame) -> dict[int, tuple[float, float]]:
    """Per band mean and spread of a symbol's score in its ordinary tokens. ``tokens`` has a row (band, score, size) per token."""
    each = tokens.filter("score <= 0").select("band", F.round(F.col("score") / F.col("size")).cast("long").alias("x"))
    sums = each.groupBy("band").agg(F.count(F.lit(1)).alias("n"), F.sum("x").alias("x"), F.sum(F.col("x") * F.col("x")).alias("xx"))
    out = {}
    for r in sums.filter(F.col("n") >= MEASURED).collect():
        mean = r["x"] / r["n"]
        out[r["band"]] = mean / MILLI, max(math.sqrt(max(r["xx"] / r["n"] - mean * mean, 0.0)) / MILLI, LEAST_SPREAD)
    return out


def p_bin(t: Column, measured: dict[int, tuple[float, float]]) -> Column:
    """Bin of the token's combined p-value."""
    score = t["score"] / MILLI
    each = score / (t["end"] - t["start"])
    by_score = F.exp(-score)
    for band, (mean, spread) in sorted(measured.items()):
        by_score = F.when(t["band"] == band, F.greatest(F.exp(-score), tail((each - mean) / spread))).otherwise(by_score)
    p = F.least(2 * F.least(t["p"], by_score), F.lit(1.0))
    return F.least(F.floor(-F.log(F.greatest(p, F.lit(1e-80))) * BINS_PER_E), F.lit(LAST_BIN)).cast("int")


def thresholds(tokens: DataFrame, rate: float) -> dict[int, int]:
    """Per band the least bin that is accepted. ``tokens`` has a row (band, bin) per tested token; the result has a row a band."""
    counts = tokens.groupBy("band", "bin").agg(F.count(F.lit(1)).alias("n"))
    down = "PARTITION BY band ORDER BY bin DESC"  # at most LAST_BIN + 1 rows in a band
    ranked = counts.selectExpr("band", "bin", f"sum(n) OVER ({down}) AS above", "sum(n) OVER (PARTITION BY band) AS tested")
    accepted = ranked.filter(F.exp(-F.col("bin") / float(BINS_PER_E)) * F.col("tested") <= rate * F.col("above"))
    return {r["band"]: r["bin"] for r in accepted.groupBy("band").agg(F.min("bin").alias("bin")).collect()}


def scan(docs: DataFrame, alpha: float = 0.001, rate: float = 0.05) -> DataFrame:
    """Per row of (doc_id, text): doc_id, base (spans of the fixed kinds), added (spans of random tokens)."""
    text = F.coalesce(docs["text"], F.lit(""))
    base = F.concat(*[found(text, pattern, group, least, gate, kind)
                      for kind, ((_, pattern, group, least), gate) in enumerate(zip(KINDS, GATES))])
    rows, _ = stage(docs.select("doc_id", F.array_sort(base).alias("base"), _tokens(text, alpha, pairs(docs)).alias("tokens")), "secrets")

    def clear(t: Column) -> Column:
        return ~F.exists("base", lambda b: (b["start"] < t["end"]) & (t["start"] < b["end"]))

    # Only what could be reported is tested: a rejection that is dropped later would raise the threshold of the others.
    tokens = rows.select(F.explode(F.filter("tokens", clear)).alias("t"))
    measured = ordinary_scores(tokens.select("t.band", "t.score", F.expr("t.end - t.start").alias("size")))
    cuts = thresholds(tokens.select("t.band", F.when(F.col("t.passes"), p_bin(F.col("t"), measured)).otherwise(0).alias("bin")), rate)

    def kept(t: Column) -> Column:
        enough = F.lit(False)
        for band, least in sorted(cuts.items()):
            enough = enough | ((t["band"] == band) & (p_bin(t, measured) >= least))
        return t["passes"] & enough & clear(t)

    added = F.transform(F.filter("tokens", kept), lambda t: F.struct(t["start"], F.lit(RANDOM).alias("kind"), t["end"]))
    return rows.select("doc_id", "base", added.cast(SPAN).alias("added"))


def listed(spans: Column) -> Column:
    """Spans as kind:start:end, comma-joined."""
    names = F.array(*[F.lit(name) for name, *_ in KINDS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


def report(docs: DataFrame, alpha: float = 0.001, rate: float = 0.05) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    rows = scan(docs, alpha, rate)

    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(kind).alias(f"n_{name}") for kind, (name, *_) in enumerate(KINDS)]
    return rows.select("doc_id", *counts, F.sha2(listed(F.col("base")), 256).alias("base_sha256"),
                       listed(F.array_sort(F.concat("base", "added"))).alias("spans"))
