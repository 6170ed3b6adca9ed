"""Language of a text by word-first backoff.

A model holds log frequencies per language of words and of character n-grams, learned
from labelled documents. A word of the model votes with its frequencies; any other word
with its longest n-grams that the model knows: 5 characters, else 4, down to 1. A vote
is the word's log probability of each language given that all are as likely. The
language with the highest sum of votes wins.

Training reads at most about ``sample`` documents, which bounds the model together with
``least``, the count below which words and n-grams are left out, and ``entries``, about
the most words and the most n-grams kept. Both bounds are shared out evenly: a language
with fewer documents than its part is learned from all of them and leaves the rest to
the others, whose documents a hash of doc_id picks; of each language (and length of
n-gram) the most frequent entries are kept in the same way, ties at the last count by
hash. Every language gets ``FLOOR`` documents at least, if it has them. So the model may
go to every task. Scoring reads whole texts; they stay where they are and no row moves.

Defined results: words are runs of letters, lower-cased; a text that is null or has no
letter is ``und`` with score 0; so is every text if nothing could be learned; ties go to
the language first in code-point order; documents with a null doc_id are never learned
from and not held out; rows are independent, so repeated rows give repeated results; an
empty table gives no rows; language, source and doc_id are no inputs of a prediction.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm.shared import in_arrow, stage

LETTERS = re.compile(r"[^\W\d_]+")
UNKNOWN = "und"
LONGEST = 5
#: New words whose votes a task remembers before it starts over.
REMEMBERED = 300_000
#: Least number of documents that a language is learned from, where it has so many, however many languages there are.
FLOOR = 50
SHARES = 1 << 30


def remainder(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string")) % 3


def grams(word: str, size: int) -> list[str]:
    """Character n-grams of a word between blanks."""
    marked = f" {word} "
    return [word] if size == 1 and len(word) == 1 else [marked[i:i + size] for i in range(len(marked) - size + 1)]


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, kind, item, n) of one task: kind 0 a word, else the length of an n-gram."""
    def rows(counts: dict[str, Counter]) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for lang, words in counts.items():
            parts: dict[tuple[int, str], int] = defaultdict(int)
            for word, n in words.items():
                parts[0, word] += n
                for size in range(1, LONGEST + 1):
                    for g in grams(word, size):
                        parts[size, g] += n
            for (kind, item), n in parts.items():
                for column, value in zip(out, (lang, kind, item, n)):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int32()), pa.array(out[2], pa.string()), pa.array(out[3], pa.int64())],
                                          names=["lang", "kind", "item", "n"])

    counts: dict[str, Counter] = defaultdict(Counter)
    for batch in batches:
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
            counts[lang].update(LETTERS.findall(text.lower()))
        if sum(map(len, counts.values())) > REMEMBERED:
            yield rows(counts)
            counts.clear()
    yield rows(counts)


def level(sizes: list[int], total: int) -> int:
    """The most that each group may give so that all give ``total`` at most; small groups leave their rest to the others."""
    left = total
    for done, size in enumerate(sorted(sizes)):
        if size * (len(sizes) - done) >= left:
            return left // (len(sizes) - done)
        left -= size
    return max(sizes, default=0)


def sampled(labelled: DataFrame, sample: int) -> DataFrame:
    """Rows (lang, text) of each language, by a hash of doc_id where it has more than its part."""
    sizes = {r["lang"]: r["count"] for r in labelled.groupBy("lang").count().collect()}  # one row per language
    most = max(level(list(sizes.values()), sample), FLOOR)
    shares = [(lang, most * SHARES // n) for lang, n in sizes.items() if n > most]
    if not shares:
        return labelled.select("lang", "text")
    few = labelled.sparkSession.createDataFrame(shares, "lang string, share long")
    rows = labelled.join(F.broadcast(few), "lang", "left")
    return rows.filter(F.col("share").isNull() | (F.pmod(F.xxhash64("doc_id", F.lit(6)), F.lit(SHARES)) < F.col("share"))).select("lang", "text")


def cuts(each: DataFrame, entries: int) -> DataFrame:
    """Per kind and language with more entries than its part: the last count that is kept and the share kept of its ties."""
    sizes = {(r["kind"], r["lang"]): r["count"] for r in each.groupBy("kind", "lang").count().collect()}  # a row per language and kind
    most = [max(level([n for (kind, _), n in sizes.items() if (kind > 0) == grams_too], entries), 1) for grams_too in (False, True)]
    down = Window.partitionBy("kind", "lang").orderBy(F.desc("n"))  # a row per distinct count
    of = each.groupBy("kind", "lang", "n").agg(F.count(F.lit(1)).alias("ties"))
    part = F.when(F.col("kind") > 0, most[1]).otherwise(most[0])
    above = of.withColumn("above", F.sum("ties").over(down) - F.col("ties")).withColumn("part", part)
    last = above.filter((F.col("above") < F.col("part")) & (F.col("above") + F.col("ties") >= F.col("part")))
    return last.select("kind", "lang", F.col("n").alias("cut"), ((F.col("part") - F.col("above")) / F.col("ties")).alias("share"))


def counts(labelled: DataFrame, sample: int = 20_000, least: int = 3, entries: int = 200_000) -> DataFrame:
    """The model as a table: lang, kind, item, n. ``labelled``: doc_id, text, lang, without nulls."""
    each = in_arrow(sampled(labelled, sample), _counted, "lang string, kind int, item string, n long")
    summed = each.groupBy("kind", "item", "lang").agg(F.sum("n").alias("n"))
    # Per item, its counts in all languages; items that are frequent in any language stay.
    items = summed.groupBy("kind", "item").agg(F.sum("n").alias("all"), F.collect_list(F.struct("lang", "n")).alias("by")).filter(F.col("all") >= least)
    rows, _ = stage(items.select("kind", "item", F.explode("by").alias("b")).select("b.lang", "kind", "item", "b.n"), "languages")
    cut = rows.join(F.broadcast(cuts(rows, entries)), ["kind", "lang"], "left")
    tied = F.pmod(F.xxhash64("item", F.lit(6)), F.lit(SHARES)) < F.col("share") * SHARES
    stay = cut.filter(F.col("cut").isNull() | (F.col("n") > F.col("cut")) | ((F.col("n") == F.col("cut")) & tied)).select("kind", "item").distinct()
    return rows.join(stay, ["kind", "item"], "left_semi").select("lang", "kind", "item", "n")


class Model:
    """The model in one task: votes per word, made when a word is first seen."""

    def __init__(self, langs: list[str], index: list[dict[str, int]], rows: np.ndarray) -> None:
        self.langs, self.known, self.rows = langs, index, rows
        self.votes = np.zeros((1024, len(langs)))
        self.clear()

    def clear(self) -> None:
        self.index: dict[str, int] = {}

    def votes_of(self, words: list[str]) -> np.ndarray:
        """A vote per word: its own row of the model, else the mean of its longest known n-grams, else zeros."""
        whole, picked, sizes = self.known[0], [], []
        for word in words:
            row = whole.get(word)
            found = [row] if row is not None else []
            for size in range(LONGEST, 0, -1):
                if found:
                    break
                of = self.known[size]
                found = [of[g] for g in grams(word, size) if g in of]
            picked += found
            sizes.append(len(found))
        run = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.rows[np.array(picked, np.int64)], axis=0)])
        ends = np.cumsum(sizes)
        return (run[ends] - run[ends - sizes]) / np.maximum(sizes, 1)[:, None]

    def sums(self, texts: list[list[str]]) -> np.ndarray:
        """Sum of votes for each list of words."""
        words = [w for text in texts for w in text]
        new = set(words).difference(self.index)
        if len(self.index) + len(new) > REMEMBERED:
            self.clear()
            new = set(words)
        if new:
            new, at = sorted(new), len(self.index)
            self.index.update(zip(new, range(at, at + len(new))))
            if len(self.index) > len(self.votes):
                self.votes = np.concatenate([self.votes, np.zeros((len(self.index), len(self.langs)))])
            self.votes[at:at + len(new)] = self.votes_of(new)
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        run = np.concatenate([np.zeros((1, len(self.langs))), np.cumsum(self.votes[at], axis=0)])
        ends = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
        return run[ends[1:]] - run[ends[:-1]]


def model_of(counted: pa.Table) -> tuple[list[str], list[dict[str, int]], np.ndarray]:
    """Languages; per kind the items and their rows; per row the log probability of each language, all languages weighing the same."""
    langs = sorted(counted.column("lang").unique().to_pylist())
    kind, n = (counted.column(c).to_numpy() for c in ("kind", "n"))
    column = np.array([langs.index(lang) for lang in counted.column("lang").to_pylist()], np.int64)
    index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
    row = np.array([index[k].setdefault(item, len(index[k])) for k, item in zip(kind, counted.column("item").to_pylist())], np.int64)
    starts = np.cumsum([0] + [len(i) for i in index])
    table, kinds = np.zeros((starts[-1], len(langs))), np.repeat(np.arange(LONGEST + 1), np.diff(starts))
    table[starts[kind] + row, column] = n
    totals = np.array([table[starts[k]:starts[k + 1]].sum(axis=0) for k in range(LONGEST + 1)])
    rate = np.log((table + 0.1) / (totals[kinds] + 1))
    rate -= np.logaddexp.reduce(rate, axis=1, keepdims=True) if len(langs) else 0
    return langs, [{item: int(starts[k]) + i for item, i in index[k].items()} for k in range(LONGEST + 1)], rate


def predict(docs: DataFrame, model: tuple) -> DataFrame:
    """Per row: doc_id, held_out, lang_pred, score (the winner's probability by its mean vote)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = Model(*shared.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [LETTERS.findall(t.lower()) if t else [] for t in batch.column("text").to_pylist()]
                names, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
                if use.langs:
                    sums = use.sums(texts)
                    for i, words in enumerate(texts):
                        if words:
                            mean = sums[i] / len(words)
                            best = int(np.argmax(np.round(mean, 9)))
                            names[i] = use.langs[best]
                            scores[i] = float(1 / np.exp(mean - mean[best]).sum())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(names, pa.string()), pa.array(scores, pa.float64())],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    read = docs.select("doc_id", F.coalesce(remainder(docs["doc_id"]) == 1, F.lit(False)).alias("held_out"), "text")
    return in_arrow(read, run, f"doc_id {kind}, held_out boolean, lang_pred string, score double")


def train(docs: DataFrame, **bounds: int) -> tuple:
    """Learn from rows (doc_id, text, lang) that are labelled and not held out."""
    labelled = docs.filter((remainder(docs["doc_id"]) != 1) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    return model_of(counts(labelled.select("doc_id", "text", "lang"), **bounds).toArrow())


def report(docs: DataFrame, **bounds: int) -> DataFrame:
    return predict(docs.select("doc_id", "text"), train(docs, **bounds))
