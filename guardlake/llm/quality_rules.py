"""Quality rules whose cutoffs are chosen so that they reject few good documents, with a guarantee.

Every document gets counts of words, symbols, repeated lines and repeated 5-word
windows. A fixed base rule rejects very short and very repetitive texts. On top of it,
six scores (``RULES``) may reject, each beyond a cutoff. Cutoffs are chosen per
stratum (language) from labelled documents:

* For a rule and a cutoff, k of the stratum's n good labelled documents lie beyond it.
  The cutoff is *certified* if at most k of n would be seen with probability
  ``delta / (strata * rules)`` or less were the true share ``risk / rules`` or more: an
  exact binomial test with a Bonferroni correction over strata and rules. The cutoffs of
  one rule are tested in order from mild to strict, up to the first that fails, which
  needs no further correction.
* Certified cutoffs count if they reject a share of the bad labelled documents at least
  ``lift`` times that of the good ones. Of these the mildest is used that still rejects
  nine tenths of what any of them does. Without one the rule does nothing in that stratum.

So with confidence 1 - delta, for all strata at once, the rules reject at most a share
``risk`` of the good documents of any stratum.

Defined results: a null text has no words (and so fails the base rule); a null language
is a stratum of its own; a stratum without enough labels has no cutoffs; labels with a
null id or value are ignored, and a document labelled both good and bad counts as good;
a repeated doc_id is judged row by row, and with a label counts once per row; an empty
table gives no rows; further columns are carried along and never read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.shared import WORD, let, packed, stage

WINDOW = 5
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines")

#: Scores of the rules (higher is worse) and their cutoffs, from strict to mild.
RULES = {
    "symbols": ("n_symbols / n_words", (0.02, 0.05, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5, 0.7, 1.0, 1.5, 2.0)),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)),
    "repeats": ("n_repeat_words / n_words", (0.01, 0.02, 0.03, 0.04, 0.05, 0.06, 0.08, 0.1, 0.12, 0.14, 0.16, 0.18)),
    "long_words": ("word_chars / n_words", (5.5, 6.0, 6.5, 7.0, 7.5, 8.0, 9.0, 10.0, 12.0, 15.0, 20.0, 30.0)),
    "short_words": ("n_words / greatest(word_chars, 1)", (0.2, 0.22, 0.25, 0.28, 0.31, 0.34, 0.37, 0.4, 0.45, 0.5, 0.6, 0.8)),
    "few_words": ("1.0 / n_words", (1 / 150, 1 / 120, 1 / 100, 1 / 80, 1 / 60, 1 / 50, 1 / 40, 1 / 30, 1 / 25, 1 / 20, 1 / 15, 1 / 12)),
}


def _repeats(words: Column) -> Column:
    """Words inside windows of five that occur twice or more in the list of words."""
    def hashed() -> Column:
        return F.transform(F.slice(words, 1, F.size(words) - (WINDOW - 1)), lambda w, i: F.xxhash64(
            w, *[F.get(words, i + j) for j in range(1, WINDOW)]))

    def covered(places: Column) -> Column:
        """Each place covers five words, but no more than up to the next place."""
        steps = F.transform(places, lambda p, i: F.least(F.coalesce(F.get(places, i + 1) - p, F.lit(WINDOW)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda a, b: a + b)

    def twice(ordered: Column) -> Column:
        def like(r: Column, other: Column) -> Column:
            return F.coalesce(F.get(ordered, other)["h"] == r["h"], F.lit(False))

        same = F.filter(ordered, lambda r, i: like(r, i + 1) | like(r, i - 1))
        return let(F.sort_array(F.transform(same, lambda r: r["i"])), covered)

    def counted(hashes: Column) -> Column:
        ordered = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        return F.when(F.size(F.array_distinct(hashes)) == F.size(hashes), F.lit(0).cast("long")).otherwise(let(ordered, twice))

    return F.when(F.size(words) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashed(), counted))


def counts(text: Column) -> Column:
    """Struct of the counts of one text."""
    text = F.coalesce(text, F.lit(""))

    def of_words(words: Column) -> Column:
        def of_lines(lines: Column) -> Column:
            return F.struct(
                F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"),
                F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
                (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
                _repeats(words).alias("n_repeat_words"), F.size(lines).cast("long").alias("n_lines"))

        return let(F.filter(F.split(text, "\n", -1), lambda x: x.rlike(WORD)), of_lines)

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), of_words)


def base_failed(c: Column) -> Column:
    return (c["n_words"] < 10) | (100 * c["n_repeat_words"] > 20 * c["n_words"])


def _score(rule: str) -> Column:
    """The rule's score; without words there is none."""
    return F.when(F.col("n_words") > 0, F.expr(f"cast({RULES[rule][0]} AS double)"))


def at_most(k: Column, n: Column, share: float) -> Column:
    """P(X <= k) for X binomial (n, share): terms from 0 up, each from the one before in logarithms."""
    odds = math.log(share / (1 - share))
    first = F.struct((n * math.log1p(-share)).alias("log"), F.exp(n * math.log1p(-share)).alias("sum"))

    def step(s: Column, i: Column) -> Column:
        return let(s["log"] + F.log((n - i + 1) / i) + odds, lambda t: F.struct(t.alias("log"), (s["sum"] + F.exp(t)).alias("sum")))

    more = F.when(k >= 1, F.sequence(F.lit(1).cast("long"), k)).otherwise(F.array().cast("array<bigint>"))
    return F.aggregate(more, first, step, lambda s: s["sum"])


def cutoffs(labelled: DataFrame, risk: float = 0.05, delta: float = 0.05, lift: float = 10.0) -> DataFrame:
    """Per stratum one row with a column per rule, null where the rule does nothing.

    ``labelled``: stratum, good (boolean) and the counts, a row per labelled document that passed the base rule.
    """
    scores = F.array(*[F.struct(F.lit(name).alias("rule"), F.array(*map(F.lit, cuts)).alias("cuts"), _score(name).alias("score"))
                       for name, (_, cuts) in RULES.items()])
    rows = labelled.select("stratum", "good", F.explode(scores).alias("s"))
    binned = rows.select("stratum", "good", F.col("s.rule").alias("rule"),
                         F.size(F.filter("s.cuts", lambda c: F.col("s.score") > c)).alias("bin"))
    counted = binned.groupBy("stratum", "rule", "bin").agg(
        F.count_if("good").alias("good"), F.count_if(~F.col("good")).alias("bad"))
    # From here on there are at most strata x rules x 13 rows.
    whole = counted.groupBy("stratum", "rule").agg(F.sum("good").alias("n_good"), F.sum("bad").alias("n_bad"),
                                                   F.collect_list(F.struct("bin", "good", "bad")).alias("bins"))
    sizes = F.create_map(*[x for name, (_, cuts) in RULES.items() for x in (F.lit(name), F.array(*map(F.lit, cuts)))])
    each = whole.select("stratum", "rule", "n_good", "n_bad", "bins", F.posexplode(F.element_at(sizes, F.col("rule"))).alias("at", "cut"))

    def beyond(name: str) -> Column:
        return F.aggregate(F.filter("bins", lambda b: b["bin"] > F.col("at")), F.lit(0).cast("long"), lambda s, b: s + b[name])

    tests = labelled.select("stratum").distinct().count() * len(RULES)
    share = risk / len(RULES)
    each = each.select("stratum", "rule", "at", "cut", "n_good", "n_bad", beyond("good").alias("k"), beyond("bad").alias("k_bad"))
    # k grows as the cutoff gets stricter, so a cutoff passes only if all milder ones do.
    sure = F.when(F.col("k") < share * F.col("n_good"), at_most(F.col("k"), F.col("n_good"), share) <= delta / max(tests, 1)).otherwise(False)
    useful = (F.col("k_bad") > 0) & (F.col("k_bad") * F.col("n_good") >= lift * F.col("k") * F.col("n_bad"))
    passed = each.filter(sure & useful)
    most = passed.groupBy("stratum", "rule").agg(F.max("k_bad").alias("most"), F.collect_list(F.struct("cut", "k_bad")).alias("cuts"))
    enough = most.select("stratum", "rule", F.array_max(F.filter("cuts", lambda c: 10 * c["k_bad"] >= 9 * F.col("most"))["cut"]).alias("cut"))
    return enough.groupBy("stratum").agg(*[F.max(F.when(F.col("rule") == name, F.col("cut"))).alias(f"cut_{name}") for name in RULES])


def rules_for(docs: DataFrame, labels: DataFrame, risk: float = 0.05, delta: float = 0.05, lift: float = 10.0) -> tuple[DataFrame, DataFrame]:
    """Per row: doc_id, stratum, the counts, base_failed; and the cutoffs per stratum (``of``). Two written tables, without texts."""
    rows = packed(docs, doc_id=docs["doc_id"], stratum=docs["lang"], c=counts(docs["text"]))
    rows, _ = stage(rows.select("doc_id", "stratum", "c.*", base_failed(F.col("c")).alias("base_failed")), "quality")
    known = labels.filter("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").alias("label_id")).agg(
        (F.max("quality") > 0).alias("good"))
    labelled = rows.filter("NOT base_failed").join(known, F.col("doc_id") == F.col("label_id"))
    return rows, stage(cutoffs(labelled, risk, delta, lift).withColumnRenamed("stratum", "of"), "cutoffs")[0]


def _kept(rows: DataFrame, cuts: DataFrame) -> DataFrame:
    """Rows with stratum, counts and base_failed, and ``kept``. There is at most one row of cutoffs for each stratum."""
    found = rows.join(cuts, F.col("stratum").eqNullSafe(F.col("of")), "left")
    rejected = F.lit(False)
    for name in RULES:
        rejected = rejected | F.coalesce(_score(name) > F.col(f"cut_{name}"), F.lit(False))
    return found.withColumn("kept", ~F.col("base_failed") & ~rejected)


def judged(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """Per row: doc_id, the counts, base_failed, kept. The counts are worked out once and written to the shared folder."""
    return _kept(*rules_for(docs, labels, **settings)).select("doc_id", *COUNTS, "base_failed", "kept")


def filtered(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    """The documents that are kept, with their columns as they are.

    Texts are neither written nor shuffled: once the cutoffs are known, each text is counted again where it is read.
    """
    _, cuts = rules_for(docs, labels, **settings)
    rows = packed(docs, stratum=docs["lang"], c=counts(docs["text"])).select("doc", "stratum", "c.*", base_failed(F.col("c")).alias("base_failed"))
    return _kept(rows, cuts).filter("kept").select("doc.*")


def report(docs: DataFrame, labels: DataFrame, **settings: float) -> DataFrame:
    return judged(docs, labels, **settings).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
