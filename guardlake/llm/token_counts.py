"""Token counts of documents under edits, by segment trees over pre-tokens.

A document's pre-tokens (what the tokenizer's pattern cuts a text into) are grouped into
leaves of ``LEAF``. Two arrays per document hold a segment tree: characters and tokens per
node, node i over nodes 2i and 2i + 1. The root has the document's count.

An edit replaces some characters. The tree is descended to the leaf that holds the place
``CONTEXT`` characters before it: the pattern looks no further ahead than that, so all
pre-tokens before that leaf stay. From there on text is cut anew until a cut falls on an
old leaf's end behind the edit; from then on all is as before. The leaves between get new
sums, and so do the nodes above them. Only that stretch is tokenized again.

The table of trees is kept; edits come as a column of arrays, in order, each relative to
the text as left by those before it. Texts stay where they are: no row moves.

Defined results: a null text counts as empty and has 0 tokens; null or empty edits change
nothing; a place beyond the text is its end; a count of removed characters beyond the
text stops there; a null insertion is empty; rows are independent, so repeated rows give
repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.shared import in_arrow

LEAF = 32
CONTEXT = 4
#: Characters of one leaf beyond which a tree is built anew.
HEAVY = 4096
REMEMBERED = 500_000

TREE = "struct<chars:array<int>,tokens:array<int>>"
EDITS = "array<struct<at:int,remove:int,insert:string>>"


class Counter:
    """A tokenizer in one task, with the counts of pre-tokens seen."""

    def __init__(self, ranks: str, pattern: str) -> None:
        with open(ranks, "rb") as lines:
            table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=table, special_tokens={})
        self.pattern = regex.compile(pattern)
        self.known: dict[str, int] = {}

    def counts(self, pretokens: list[str]) -> list[int]:
        if len(self.known) > REMEMBERED:
            self.known.clear()
        known = self.known
        for p in set(pretokens).difference(known):
            known[p] = len(self.encoding.encode_ordinary(p))
        return [known[p] for p in pretokens]


class Tree:
    """The segment tree of one document."""

    def __init__(self, chars: np.ndarray, tokens: np.ndarray) -> None:
        self.chars, self.tokens, self.width = chars, tokens, len(chars) // 2

    @classmethod
    def of_leaves(cls, chars: list[int], tokens: list[int]) -> Tree:
        width = 1
        while width < max(len(chars), 1):
            width *= 2
        nodes = [np.zeros(2 * width, np.int32) for _ in range(2)]
        for node, leaves in zip(nodes, (chars, tokens)):
            node[width:width + len(leaves)] = leaves
            at = width
            while at > 1:
                node[at // 2:at] = node[at:2 * at:2] + node[at + 1:2 * at:2]
                at //= 2
        return cls(*nodes)

    @classmethod
    def of_pretokens(cls, sizes: list[int], tokens: list[int]) -> Tree:
        cuts = np.arange(0, len(sizes), LEAF)
        if not len(cuts):
            return cls.of_leaves([0], [0])
        return cls.of_leaves(np.add.reduceat(np.array(sizes), cuts), np.add.reduceat(np.array(tokens), cuts))

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, and where it begins."""
        node, begin = 1, 0
        while node < self.width:
            node *= 2
            if place - begin >= self.chars[node]:
                begin += int(self.chars[node])
                node += 1
        return node - self.width, begin

    def put(self, leaf: int, chars: int, tokens: int) -> None:
        node = leaf + self.width
        more = chars - int(self.chars[node]), tokens - int(self.tokens[node])
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def edited(self, counter: Counter, text: str, at: int, remove: int, insert: str) -> tuple[Tree, str, int]:
        """The tree and text after an edit, and the characters that were tokenized again."""
        at = min(max(at, 0), len(text))
        stop = min(at + max(remove, 0), len(text))
        new = text[:at] + insert + text[stop:]
        leaf, begin = self.leaf_at(max(min(at - CONTEXT, len(text) - 1), 0))
        # Leaf ends behind the edit, in the new text, until one is a cut.
        last, end, shift = leaf, begin + int(self.chars[leaf + self.width]), len(new) - len(text)
        pretokens, place = [], begin
        for found in counter.pattern.finditer(new, begin):
            pretokens.append(found.group())
            place = found.end()
            while last + 1 < self.width and (end < stop or end + shift < place):
                last += 1
                end += int(self.chars[last + self.width])
            if end >= stop and end + shift == place:
                break
        else:
            last, place = self.width - 1, len(new)
        if place - begin > HEAVY:
            return counted(counter, new)[0], new, len(new)
        self.put(leaf, place - begin, sum(counter.counts(pretokens)))
        for other in range(leaf + 1, last + 1):
            if self.chars[other + self.width]:
                self.put(other, 0, 0)
        return self, new, place - begin


def counted(counter: Counter, text: str) -> tuple[Tree, int]:
    pretokens = counter.pattern.findall(text)
    tree = Tree.of_pretokens([len(p) for p in pretokens], counter.counts(pretokens))
    return tree, int(tree.tokens[1])


_COUNTERS: dict[tuple[str, str], Counter] = {}


def _counter(ranks: str, pattern: str) -> Counter:
    if (ranks, pattern) not in _COUNTERS:
        _COUNTERS[ranks, pattern] = Counter(ranks, pattern)
    return _COUNTERS[ranks, pattern]


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays) if arrays else np.empty(0, np.int32), pa.int32()))


def build(docs: DataFrame, ranks: str, pattern: str, *carry: str) -> DataFrame:
    """Per row of (doc_id, text): the columns to carry along, and ``tree``."""
    kinds = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in docs.select(*carry).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                trees = [counted(counter, t or "")[0] for t in batch.column("text").to_pylist()]
                tree = pa.StructArray.from_arrays([_lists([t.chars for t in trees]), _lists([t.tokens for t in trees])], names=["chars", "tokens"])
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in carry), tree], names=[*carry, "tree"])

    return in_arrow(docs.select(*dict.fromkeys([*carry, "text"])), run, f"{kinds}tree {TREE}")


def recount(rows: DataFrame, ranks: str, pattern: str, text: bool = False) -> DataFrame:
    """Per row of (doc_id, text, tree, edits): doc_id, tokens_before, tokens_after, n_edits, chars_again; with ``text`` also text and tree after."""
    kind = rows.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(ranks, pattern)
        for batch in batches:
            out: list[list] = [[], [], [], []]
            texts, trees = [], []
            tree = batch.column("tree")
            for old, chars, tokens, edits in zip(batch.column("text").to_pylist(), tree.field("chars"), tree.field("tokens"), batch.column("edits").to_pylist()):
                now = Tree(chars.values.to_numpy().copy(), tokens.values.to_numpy().copy())
                old, before, again = old or "", int(now.tokens[1]), 0
                for e in edits or []:
                    now, old, more = now.edited(counter, old, e["at"] or 0, e["remove"] or 0, e["insert"] or "")
                    again += more
                for column, value in zip(out, (before, int(now.tokens[1]), len(edits or []), again)):
                    column.append(value)
                if text:
                    texts.append(old)
                    trees.append(now)
            columns = [batch.column("doc_id"), *(pa.array(c, pa.int64()) for c in out)]
            names = ["doc_id", "tokens_before", "tokens_after", "n_edits", "chars_again"]
            if text:
                columns += [pa.array(texts, pa.string()), pa.StructArray.from_arrays(
                    [_lists([t.chars for t in trees]), _lists([t.tokens for t in trees])], names=["chars", "tokens"])]
                names += ["text", "tree"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    more = f", text string, tree {TREE}" if text else ""
    return in_arrow(
        rows.select("doc_id", "text", "tree", "edits"), run, f"doc_id {kind}, tokens_before long, tokens_after long, n_edits long, chars_again long{more}")


def revision(text: Column, doc_id: Column, source: Column) -> Column:
    """A reproducible revision of a document: a word put in near its first third, some characters replaced near its last, a line added."""
    text = F.coalesce(text, F.lit(""))
    size, spread = F.length(text), F.pmod(F.xxhash64(doc_id), F.lit(97)).cast("int")

    def edit(at: Column, remove: Column, insert: Column) -> Column:
        return F.struct(at.cast("int").alias("at"), remove.cast("int").alias("remove"), insert.alias("insert"))

    return F.array(
        edit(F.floor(size / 3) + spread, F.lit(0), F.lit(" revised ")),
        edit(F.floor(size * 2 / 3), spread, F.concat(F.lit("don't, "), F.coalesce(source, F.lit("")))),
        edit(size + 1000, F.lit(0), F.lit("\nLast changed: 2024-05-01\n"))).cast(EDITS)
