"""A language model that codes words bit by bit and mixes several predictions of each bit by logistic mixing.

Tokens are words (A-Z lowered) and one end per text. The ``HEAD`` commonest training words,
the end and an escape have a Huffman code; an escaped word is spelled in bytes, which have a
Huffman code of their own. So a token is a path of bits, each a decision at a node of a
tree, and every predictor looks up its node under a hashed context:

* words: the node alone; with the word before; with the two words before (two tables of
  2 ** ``WORD_BITS`` slots of counts of zeros and ones); and the decisions that this text took
  at the node before, a cache that starts empty with each text;
* spelling: the node with the one, two, three and four bytes before (four tables of
  2 ** ``BYTE_BITS`` slots), learned from every distinct training word.

The stretched predictions are combined by weights, of which a gate picks a set by how much
each context has been seen. Weights move online: every document starts from the corpus'
weights and moves them, segment by segment, by the errors of its own bits. The mix is
refined by a map from (gate, mixed value) to the share of ones seen in training, averaged
with it. The sum of all bits' costs is the text's log probability, and over its bytes the
bits per byte.

How Spark does it: training words are counted per task and then by word, all of them; counts
of bits are added up in dense arrays per task and summed in pieces per (table, piece);
the mixing weights and the map (a classifier of bits) are fitted on all training documents,
where a bit does not count in its own prediction, as sums per task. Tables of fixed size, whatever the input, go
to every task: about 55 MB. The base score needs the exact count of every word: those of the
head are at hand, the other words of each document (few) meet their counts in a join.

Defined results: a null or empty text is the end alone; a document with a null doc_id trains
and is not held out (its remainder is unknown); repeated rows count and train as often as they
are there; a text of any length is one sequence, in segments that grow with it; words are
any bytes but the separators; without training documents nothing is known, the base score
is 0 and the model codes by equal chances; an empty table gives no rows; further columns
are never read.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.shared import stage

HEAD = 131_070
WORD_BITS, BYTE_BITS = 22, 18
PIECE = 1 << 16
#: Gates of the word bits, then of the spelling bits; inputs of each.
WORD_GATES, BYTE_GATES, INPUTS = 36, 9, 4
GATES = WORD_GATES + BYTE_GATES
#: Cells of the map per gate: quarters of a mixed value from -LIMIT to LIMIT.
LIMIT = 12
BINS = 8 * LIMIT + 1
RATE = 0.02
CACHE_BITS = 19
#: Rows and bytes of text that are worked on at once; a longer text is worked on alone.
ROWS, BYTES = 256, 3 << 18
#: Tokens and words whose bits are counted at once: some 20 and 70 bits each, ten numbers a bit.
TOKENS, SPELLED = 1 << 14, 1 << 12
#: Tokens that are mixed at once, by whole texts: some 16 bits each, twenty numbers a bit.
BLOCK = 1 << 13
#: Slices whose words are looked up together.
TOGETHER = 8

#: Counts of a context are kept up to this; small tables by count stay in a core's cache.
MOST = 1023
_LEVEL = np.zeros(2 * MOST + 1, np.int64)
_LEVEL[1:4], _LEVEL[4:32], _LEVEL[32:] = 1, 2, 3
#: A gate is a sum of three levels, 0 to 3 and twice 0 to 2.
_LOW = np.minimum(_LEVEL, 2).astype(np.int32)
_LOG = np.log(np.arange(MOST + 1, dtype=np.float64) + 0.4).astype(np.float32)


#: Between these sizes the upper two bits of a number's exponent, once divided by ``SCALE``, are 01 and can carry a tag.
SCALE, LEAST = np.float32(1 << 16), np.float32(2.0 ** -46)
_EXPONENT = np.uint32(3 << 29)


def tagged(x: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """Numbers that carry a tag of 0 to 3: one look-up brings both. A 0 becomes ``LEAST``, which no sum of theirs feels."""
    x = (np.where(x == 0, LEAST, x) / SCALE).view(np.uint32)
    x &= ~_EXPONENT
    x |= tag.astype(np.uint32) << np.uint32(29)
    return x


def untagged(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers, exactly, and their tags; ``x`` is used up."""
    tag = (x >> np.uint32(29)).view(np.int32)
    tag &= 3
    x &= ~_EXPONENT
    x |= np.uint32(1 << 29)
    x = x.view(np.float32)
    x *= SCALE
    return x, tag


def stretched(table: np.ndarray, own: bool) -> np.ndarray:
    """Per slot of counts the stretched prediction, tagged with the level of the count; with ``own`` per slot and bit, that bit not counted."""
    out = np.empty(len(table) << own, np.uint32)
    for at in range(0, len(table), PIECE):
        part = table[at:at + PIECE]
        zero, one = (part & np.uint32(65_535)).astype(np.int64), (part >> np.uint32(16)).astype(np.int64)
        if own:
            zero, one = np.stack([np.maximum(zero - 1, 0), zero], axis=1).reshape(-1), np.stack([one, np.maximum(one - 1, 0)], axis=1).reshape(-1)
        out[at << own:(at << own) + len(zero)] = tagged(_LOG[one] - _LOG[zero], _LEVEL[zero + one])
    return out


# --- tokens ---


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False))
        at = 0
        while at < batch.num_rows:
            base = sizes[at - 1] if at else 0
            end = max(at + 1, min(at + ROWS, int(np.searchsorted(sizes, base + BYTES, "right"))))
            yield batch.slice(at, end - at)
            at = end


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in a row, and where those of each text begin (one more entry than texts)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    return flat.filter(pa.array(real)), np.concatenate([[0], np.cumsum(real)])[ends - ends[0]]


def bytes_of(raw: pa.Array) -> np.ndarray:
    """All bytes of binary values without nulls, one after the other."""
    ends = np.frombuffer(raw.buffers()[1], np.int32)[raw.offset:raw.offset + len(raw) + 1] if len(raw) else [0]
    return np.frombuffer(raw.buffers()[2], np.uint8)[ends[0]:ends[-1]] if ends[-1] > ends[0] else np.zeros(0, np.uint8)


def runs(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indices of runs, one after the other."""
    index = (starts - (np.cumsum(lengths) - lengths)).repeat(lengths)
    index += np.arange(len(index))
    return index


def ragged(starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Indices of runs, one after the other, and the run that each belongs to."""
    owner = np.repeat(np.arange(len(starts)), lengths)
    first = np.cumsum(lengths) - lengths
    return np.arange(len(owner)) + (starts - first)[owner], owner


# --- codes ---


def huffman(weights: list[int]) -> dict[str, np.ndarray]:
    """Paths of the symbols: ``start`` and ``length`` per symbol into ``node``, ``bit`` and ``mark`` (the node's hash); ``stretch`` per node."""
    n = len(weights)
    heap = [(w, i) for i, w in enumerate(weights)]
    heapq.heapify(heap)
    parent, side, total = np.zeros(2 * n, np.int64), np.zeros(2 * n, np.uint8), list(weights)
    stretch = np.zeros(max(n - 1, 1), np.float32)
    for at in range(n, 2 * n - 1):
        (a, zero), (b, one) = heapq.heappop(heap), heapq.heappop(heap)
        parent[zero] = parent[one] = at
        side[one] = 1
        stretch[at - n] = math.log((b + 0.5) / (a + 0.5))
        total.append(a + b)
        heapq.heappush(heap, (a + b, at))
    symbol, where, levels = np.arange(n), np.arange(n), []
    while n > 1 and len(symbol):
        levels.append((symbol, parent[where] - n, side[where]))
        where = parent[where]
        on = where != 2 * n - 2
        symbol, where = symbol[on], where[on]
    if not levels:
        return {"start": np.zeros(n, np.int64), "length": np.zeros(n, np.int64), "node": np.zeros(0, np.int32), "bit": np.zeros(0, np.uint8), "stretch": stretch, "mark": np.zeros(0, np.uint64)}
    symbols, nodes, bits = (np.concatenate([x[k] for x in reversed(levels)]) for k in range(3))  # from the root down
    order = np.argsort(symbols, kind="stable")
    length = np.bincount(symbols, minlength=n)
    return {"start": np.cumsum(length) - length, "length": length, "node": nodes[order].astype(np.int32), "bit": bits[order], "stretch": stretch,
            "mark": marks(nodes[order])}


def _spread(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


def marks(node: np.ndarray) -> np.ndarray:
    return _spread(node.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def _slot(context: np.ndarray, node: np.ndarray, bits: int) -> np.ndarray:
    """A slot for each context (a spread hash) and node (its ``mark``)."""
    slot = context ^ node
    slot *= np.uint64(0xD6E8FEB86659FD93)
    slot >>= np.uint64(64 - bits)
    return slot.view(np.int64)


class Speller:
    """Bits of words in bytes: each word, then an end (symbol 256)."""

    def __init__(self, code: dict[str, np.ndarray]):
        self.code = code

    def bits(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Number of bits per word; the bits, and the slots of their four contexts."""
        raw = words.cast(pa.binary())
        size = pc.binary_length(raw).to_numpy(zero_copy_only=False).astype(np.int64)
        letters = bytes_of(raw).astype(np.int64)
        ends = np.cumsum(size + 1) - 1
        symbol = np.full(len(letters) + len(size), 256)
        inside = np.ones(len(symbol), bool)
        inside[ends] = False
        symbol[inside] = letters
        place = np.arange(len(symbol)) - np.repeat(np.cumsum(size + 1) - (size + 1), size + 1)
        contexts, value = [], np.zeros(len(symbol), np.uint64)
        for k in range(1, INPUTS + 1):
            before = np.where(place >= k, np.concatenate([np.zeros(k, np.int64), symbol[:-k]])[:len(symbol)], 257).astype(np.uint64)
            value = value * np.uint64(517) + before + np.uint64(1)
            contexts.append(_spread(value + np.uint64(k << 40)))
        index, owner = ragged(self.code["start"][symbol], self.code["length"][symbol])
        mark, bit = self.code["mark"][index], self.code["bit"][index]
        per_word = np.add.reduceat(self.code["length"][symbol], np.concatenate([[0], ends[:-1] + 1])) if len(size) else np.zeros(0, np.int64)
        return per_word, bit, [_slot(c[owner], mark, BYTE_BITS).astype(np.int32) for c in contexts]


# --- sums of dense tables over tasks ---


def _pieces(tables: dict[int, np.ndarray], task: int) -> Iterator[pa.RecordBatch]:
    pack = zstandard.ZstdCompressor(level=1)
    for kind, table in tables.items():
        for at in range(0, len(table), PIECE):
            piece = table[at:at + PIECE]
            if piece.any():
                yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([at // PIECE], pa.int32()), pa.array([task], pa.int64()),
                                                  pa.array([pack.compress(piece.astype(np.int64, copy=False).tobytes())], pa.binary())], names=["kind", "piece", "task", "data"])


PIECES = "kind int, piece int, task long, data binary"


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of this task's (kind, piece) added up as they come."""
    sums: dict[tuple[int, int, int], np.ndarray] = {}
    unpack = zstandard.ZstdDecompressor()
    for batch in batches:
        for kind, piece, salt, data in zip(*[batch.column(c).to_pylist() for c in ("kind", "piece", "task", "data")]):
            values = np.frombuffer(unpack.decompress(data), np.int64)
            at = kind, piece, salt
            sums[at] = sums[at] + values if at in sums else values
    pack = zstandard.ZstdCompressor(level=1)
    for (kind, piece, salt), values in sums.items():
        yield pa.RecordBatch.from_arrays([pa.array([kind], pa.int32()), pa.array([piece], pa.int32()), pa.array([salt], pa.int64()),
                                          pa.array([pack.compress(values.tobytes())], pa.binary())], names=["kind", "piece", "task", "data"])


def totals(pieces: DataFrame, sizes: dict[int, int], salts: int) -> dict[int, np.ndarray]:
    """The tables of all tasks added up: first in ``salts`` parts, so that no task reads from all, then altogether."""
    parts = pieces.withColumn("task", F.pmod("task", F.lit(salts))).repartition("kind", "piece", "task").mapInArrow(_summed, PIECES)
    whole = parts.withColumn("task", F.lit(0).cast("long")).repartition("kind", "piece").mapInArrow(_summed, PIECES)
    out = {k: np.zeros(n, np.int64) for k, n in sizes.items()}
    unpack = zstandard.ZstdDecompressor()
    for r in whole.toLocalIterator():  # bounded: the sizes of the tables
        values = np.frombuffer(unpack.decompress(bytes(r["data"])), np.int64)
        out[r["kind"]][r["piece"] * PIECE:r["piece"] * PIECE + len(values)] = values
    return out


def _counts(table: np.ndarray) -> np.ndarray:
    """Counts of zeros (low) and ones (high) per slot, 16 bits each, divided together where they are larger."""
    pairs = table.reshape(-1, 2)
    most = pairs.max(axis=1)
    down = np.maximum(1, -(-most // MOST))[:, None]
    pairs = -(-pairs // down)
    return (pairs[:, 0] + (pairs[:, 1] << 16)).astype(np.uint32)


# --- learning ---


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def emit() -> pa.RecordBatch:
        counted = pa.chunked_array(held, pa.string()).value_counts()
        return pa.RecordBatch.from_arrays([counted.field("values"), counted.field("counts")], names=["word", "n"])

    for part in slices(batches):
        flat, _ = words_of(part.column("text"))
        held.append(flat)
        n += len(flat)
        if n > 1_000_000:
            yield emit()
            held, n = [], 0
    yield emit()


def _letters(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    seen = np.zeros(PIECE, np.int64)
    for batch in batches:
        seen[:256] += np.bincount(bytes_of(batch.column("word").cast(pa.binary())), minlength=256)
        seen[256] += batch.num_rows
    yield from _pieces({0: seen}, _task())


def _task() -> int:
    from pyspark import TaskContext
    return TaskContext.get().partitionId()


def _spelling(code: dict[str, np.ndarray]):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = {k: np.zeros(2 << BYTE_BITS, np.int64) for k in range(INPUTS)}
        speller = Speller(code)
        for batch in batches:
            for at in range(0, batch.num_rows, SPELLED):
                _, bit, slots = speller.bits(batch.column("word").slice(at, SPELLED))
                for k, slot in enumerate(slots):
                    np.add.at(tables[k], 2 * slot + bit, np.int64(1))
        yield from _pieces(tables, _task())

    return learn


class Model:
    """What every task needs; arrays of bounded size."""

    def __init__(self, head: pa.Array, counts: np.ndarray, ends: int, code: dict, letters: dict):
        self.head, self.counts, self.ends, self.code, self.letters = head, counts, ends, code, letters
        self.tables: list[np.ndarray] = []
        self.spelling: list[np.ndarray] = []
        self._ready: tuple = ()

    def path(self) -> np.ndarray:
        """Stretched shares along the symbols' paths, tagged with their bits."""
        return tagged(self.code["stretch"][self.code["node"]], self.code["bit"])

    def ready(self, own: bool) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """What mixing looks up: the path and the stretched tables of words and spelling; kept for one ``own``."""
        made_of = [own, *self.tables, *self.spelling]
        if not self._ready or any(a is not b for a, b in zip(made_of, self._ready[0], strict=True)):
            self._ready = ()
            self._ready = made_of, (self.path(), *[[stretched(t, own) for t in group] for group in (self.tables, self.spelling)])
        return self._ready[1]

    @property
    def end(self) -> int:
        return len(self.head)

    def __getstate__(self) -> dict:
        """Arrays are sent packed; what follows from others is made again."""
        pack = zstandard.ZstdCompressor(level=3)
        code = {k: (v.dtype.str, pack.compress(np.ascontiguousarray(v).tobytes())) for k, v in self.code.items() if k != "mark"}
        tables = [[pack.compress(t.tobytes()) for t in group] for group in (self.tables, self.spelling)]
        return {**self.__dict__, "code": code, "tables": tables[0], "spelling": tables[1], "_ready": ()}

    def __setstate__(self, state: dict) -> None:
        unpack = zstandard.ZstdDecompressor()
        self.__dict__.update(state)
        self.code = {k: np.frombuffer(unpack.decompress(v), kind) for k, (kind, v) in state["code"].items()}
        self.code["mark"] = marks(self.code["node"])
        self.tables, self.spelling = [[np.frombuffer(unpack.decompress(t), np.uint32) for t in state[group]] for group in ("tables", "spelling")]

    def words(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
        """All words of the texts, where those of each text begin, and the words' symbols."""
        flat, starts = words_of(texts)
        return flat, starts, pc.fill_null(pc.index_in(flat, value_set=self.head), len(self.head) + 1).to_numpy(zero_copy_only=False)

    def slices(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, tuple]]:
        """Slices with their words, looked up for several slices at once, as each look-up hashes the whole head."""
        for batch in batches:
            parts, at = list(slices(iter([batch]))), 0
            while parts:
                many = 1 + next((k for k, part in enumerate(parts[:TOGETHER]) if part.num_rows == 1), TOGETHER - 1)  # a long text ends them
                group, parts = parts[:many], parts[many:]
                rows = np.cumsum([0, *[part.num_rows for part in group]])
                flat, starts, found = self.words(batch.column("text").slice(at, rows[-1]))
                for part, low, high in zip(group, rows, rows[1:]):
                    first, last = starts[low], starts[high]
                    yield part, (flat.slice(first, last - first), starts[low:high + 1] - first, found[first:last])
                at += rows[-1]

    def symbols(self, flat: pa.Array, starts: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Symbol of every token (words, then the end of each text), where each text begins, and which tokens are escaped."""
        docs = len(starts) - 1
        at = starts + np.arange(docs + 1)
        symbol = np.full(len(flat) + docs, self.end, np.int64)
        inside = np.ones(len(symbol), bool)
        inside[at[1:] - 1] = False
        symbol[inside] = found
        return symbol, at, np.flatnonzero(symbol == self.end + 1)


def word_contexts(symbol: np.ndarray, at: np.ndarray) -> list[np.ndarray]:
    """Hashed contexts of each token: the symbol before, and the two before, from the beginning of its text."""
    one = np.concatenate([[0], symbol[:-1] + 1]) if len(symbol) else symbol
    two = np.concatenate([[0], one[:-1]]) if len(symbol) else symbol
    one[at[:-1]] = 0
    two[at[:-1]] = 0
    second = at[:-1] + 1
    two[second[second < at[1:]]] = 0
    one, two = one.astype(np.uint64), two.astype(np.uint64)
    return [_spread(one + np.uint64(1 << 50)), _spread(one * np.uint64(0x2545F4914F6CDD1D) + two + np.uint64(1 << 51))]


def _word_tables(shared):
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        tables = [np.zeros(2 << WORD_BITS, np.int32) for _ in range(2)]
        path = model.path()
        for _, words in model.slices(batches):
            symbol, at, _ = model.symbols(*words)
            contexts = word_contexts(symbol, at)
            for low in range(0, len(symbol), TOKENS):
                some = symbol[low:low + TOKENS]
                length = model.code["length"][some]
                index = runs(model.code["start"][some], length)
                mark, (_, bit) = model.code["mark"].take(index), untagged(path.take(index))
                for table, context in zip(tables, contexts):
                    slot = _slot(context[low:low + TOKENS].repeat(length), mark, WORD_BITS)
                    slot <<= 1
                    slot += bit
                    np.add.at(table, slot, np.int32(1))
        yield from _pieces(dict(enumerate(tables)), _task())  # long numbers by pieces: the tables would take 64 MB each

    return learn


# --- mixing ---


class Mixer:
    """The fitted part: weights per gate and input, and the map per gate and mixed value. A few thousand numbers."""

    def __init__(self):
        self.weights = np.full((GATES, INPUTS), 0.3, np.float32)
        self.map = np.tile(1 / (1 + np.exp(LIMIT - (np.arange(BINS) + 0.5) / 4)), GATES).astype(np.float32)

    def fit(self, moved: np.ndarray, bits: np.ndarray, seen: np.ndarray) -> None:
        bits = bits.reshape(-1, 1)
        self.weights = np.where(bits > 0, moved.reshape(GATES, INPUTS) / np.maximum(bits, 1), self.weights).astype(np.float32)
        seen = seen.reshape(-1, 2)
        n = seen.sum(axis=1)
        self.map = np.where(n >= 30, (seen[:, 1] + 0.5) / (n + 1), self.map).astype(np.float32)


def _segments(lengths: np.ndarray) -> Iterator[tuple[int, int]]:
    """Tokens of each round: 32 at first, then an eighth of what has gone before."""
    at, most = 0, int(lengths.max(initial=0))
    while at < most:
        end = at + max(32, at // 8)
        yield at, end
        at = end


def mixed(model: Model, mixer: Mixer, part: pa.RecordBatch, own: bool, words: tuple | None = None):
    """Bits of cost per text by online mixing from the mixer's weights.

    With ``own`` the texts were trained on: a bit is taken out of the counts that predict it, and costs stay 0. Returns
    (costs, symbols, starts, escaped tokens, their words, weights at the end, bits per (text, gate), map counts).
    """
    flat, starts, found = words or model.words(part.column("text"))
    symbol, at, escaped = model.symbols(flat, starts, found)
    docs, lengths = len(at) - 1, np.diff(at)
    contexts = word_contexts(symbol, at)
    doc_of = np.repeat(np.arange(docs), lengths)
    tail = flat.take(pa.array(escaped - doc_of[escaped])).dictionary_encode()  # a text's end stands before each later text's words
    speller = Speller(model.letters)
    spell_size, spell_bit, spell_slot = speller.bits(tail.dictionary)
    spell_start = np.cumsum(spell_size) - spell_size
    tail_code = np.zeros(len(symbol), np.int64)
    tail_code[escaped] = tail.indices.to_numpy()
    is_tail = symbol == model.end + 1
    path, tables, spelling = model.ready(own)
    weights = np.repeat(mixer.weights.T.reshape(INPUTS, 1, GATES), docs, axis=1)
    cache = np.zeros(1 << CACHE_BITS, np.int64)  # zeros in the lower half of a number, ones in the upper
    text_hash = _spread(np.arange(1, docs + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
    cost, used = np.zeros(docs), np.zeros((docs, GATES))
    seen = np.zeros(GATES * BINS * 2)

    def looked_up(table: np.ndarray, slot: np.ndarray, bit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if own:
            slot = slot << 1
            slot += bit
        return untagged(table.take(slot))

    def step(docs_: np.ndarray, local: np.ndarray, per_doc: np.ndarray, gate: np.ndarray, bit: np.ndarray, inputs: tuple) -> None:
        """Mixes bits of some documents and moves their weights; ``per_doc`` bits of each, one document after the other."""
        set_ = (np.arange(len(docs_)) * GATES).repeat(per_doc)
        set_ += gate
        value = local[0].take(set_, mode="clip")
        value *= inputs[0]
        for w, x in zip(local[1:], inputs[1:]):
            w = w.take(set_, mode="clip")
            w *= x
            value += w
        np.clip(value, -LIMIT, LIMIT, out=value)
        cell = ((value + LIMIT) * 4).astype(np.int32)
        cell += gate * np.int32(BINS)
        p = np.negative(value, out=value)
        np.exp(p, out=p)
        p += 1
        np.reciprocal(p, out=p)
        error = bit.astype(np.float32)
        if own:
            cell <<= 1
            cell += bit
            seen[:] += np.bincount(cell, minlength=len(seen))
        else:
            chance = mixer.map.take(cell, mode="clip")
            chance += p
            chance *= 0.5
            chance += error
            chance -= 1  # its size is the chance of the bit that came
            np.log2(np.abs(chance, out=chance), out=chance)
            some = np.flatnonzero(per_doc)
            cost[docs_[some]] -= np.add.reduceat(chance, (np.cumsum(per_doc) - per_doc)[some], dtype=np.float64)
        error -= p
        n = np.bincount(set_, minlength=local.shape[1])
        used[docs_] += n.reshape(-1, GATES)
        pace = RATE * np.minimum(1, 32 / np.maximum(n, 1))
        for w, x in zip(local, inputs):
            move = np.bincount(set_, error * x, local.shape[1])
            move *= pace
            w += move
            np.clip(w, -2, 6, out=w)

    for low, high in _segments(lengths):
        live = np.flatnonzero(lengths > low)
        sizes = np.minimum(lengths[live], high) - low
        cuts = np.flatnonzero(np.diff((np.cumsum(sizes) - sizes) // BLOCK)) + 1
        visited = []
        for docs_, size in zip(np.split(live, cuts), np.split(sizes, cuts)):
            local = weights[:, docs_].reshape(INPUTS, -1)
            tokens, who = ragged(at[docs_] + low, size)
            some = symbol[tokens]
            length = model.code["length"][some]
            index = runs(model.code["start"][some], length)
            mark = model.code["mark"].take(index)
            x0, bit = untagged(path.take(index))
            x1, gate = looked_up(tables[0], _slot(contexts[0][tokens].repeat(length), mark, WORD_BITS), bit)
            x2, level = looked_up(tables[1], _slot(contexts[1][tokens].repeat(length), mark, WORD_BITS), bit)
            place = _slot(text_hash[docs_[who]].repeat(length), mark, CACHE_BITS)
            both = cache.take(place)
            one = both >> 32
            both &= 0xFFFFFFFF
            x3 = _LOG.take(one, mode="clip")  # counts beyond MOST are as MOST
            x3 -= _LOG.take(both, mode="clip")
            one += both
            gate *= 3
            gate += np.minimum(level, 2, out=level)
            gate *= 3
            gate += _LOW.take(one, mode="clip")
            visited.append((place, bit))
            step(docs_, local, np.add.reduceat(length, np.cumsum(size) - size), gate, bit, (x0, x1, x2, x3))

            spelled = np.flatnonzero(is_tail[tokens])
            if len(spelled):
                code = tail_code[tokens[spelled]]
                length = spell_size[code]
                index = runs(spell_start[code], length)
                bit = spell_bit.take(index).astype(np.int32)
                inputs, levels = zip(*[looked_up(t, s.take(index).astype(np.int64), bit) for t, s in zip(spelling, spell_slot)])
                gate = np.minimum(levels[2], 2)
                gate *= 3
                gate += np.minimum(levels[3], 2)
                gate += WORD_GATES
                step(docs_, local, np.bincount(who[spelled], length, len(docs_)).astype(np.int64), gate, bit, inputs)
            weights[:, docs_] = local.reshape(INPUTS, -1, GATES)
        for place, bit in visited:  # documents share the cache, so it changes between segments only
            more = bit.astype(np.int64)
            more *= (1 << 32) - 1
            more += 1
            np.add.at(cache, place, more)
    return cost, symbol, at, escaped, tail, weights.reshape(INPUTS, -1).T, used.reshape(-1), seen


def _learned(shared):
    """Sums over a task's training texts: weights at the end of each, by the bits that moved them, and the map's counts."""
    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        now, moved, bits, seen = Mixer(), np.zeros((GATES, INPUTS)), np.zeros(GATES), np.zeros(GATES * BINS * 2)
        for part, words in model.slices(batches):
            *_, weights, used, counts = mixed(model, now, part, own=True, words=words)
            used = used.reshape(-1, GATES)
            share = (weights.reshape(-1, GATES, INPUTS) * used[:, :, None]).sum(axis=0)
            moved, bits, seen = moved + share, bits + used.sum(axis=0), seen + counts
            n = used.sum(axis=0)[:, None]
            now.weights = np.where(n > 0, share / np.maximum(n, 1), now.weights).astype(np.float32)
        out = np.zeros(PIECE, np.int64)
        fixed = np.concatenate([np.rint(moved.reshape(-1) * 4096), bits, seen]).astype(np.int64)
        out[:len(fixed)] = fixed
        yield from _pieces({0: out}, _task())

    return learn


def _scored(shared, mixer: Mixer, all_tokens: int, distinct: int):
    scale = math.log10(all_tokens + distinct + 1)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        logs = np.append(np.log10(model.counts + 1.0), math.log10(model.ends + 1)) - scale
        kind = pa.struct([("word", pa.string()), ("times", pa.int64())])
        for part, found in model.slices(batches):
            cost, symbol, at, escaped, tail, *_ = mixed(model, mixer, part, own=False, words=found)
            docs, lengths = len(at) - 1, np.diff(at)
            doc = np.repeat(np.arange(docs), lengths)
            common = symbol <= model.end
            base = np.bincount(doc[common], logs[symbol[common]], docs)
            head = np.bincount(doc[symbol < model.end], minlength=docs)
            pairs, times = np.unique(doc[escaped] * max(len(tail.dictionary), 1) + tail.indices.to_numpy(), return_counts=True)
            ends = np.searchsorted(pairs // max(len(tail.dictionary), 1), np.arange(docs + 1))
            words = tail.dictionary.take(pa.array(pairs % max(len(tail.dictionary), 1)))
            rare = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([words, pa.array(times, pa.int64())], fields=list(kind)))
            size = pc.fill_null(pc.binary_length(part.column("text")), 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), part.column("doc_id"), part.column("held_out"), pa.array(lengths, pa.int64()),
                 pa.array(head + (model.ends > 0), pa.int64()), pa.array(base), pa.array(-cost * math.log10(2)), size.cast(pa.int64()), rare],
                names=["row", "doc_id", "held_out", "n_tokens", "known", "base", "score", "bytes", "rare"])

    return score


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 7 == 2, F.lit(False))


def train(texts: DataFrame):
    """The model as a broadcast, the mixer, the table of all word counts (word, n), the number of training tokens and of distinct ones. ``texts``: text."""
    spark, tasks = texts.sparkSession, texts.rdd.getNumPartitions()
    salts = max(1, math.isqrt(tasks))
    ends = texts.count()
    words = texts.mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    words, _ = stage(words, "words")
    all_words, distinct = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    top = words.orderBy(F.desc("n"), "word").limit(HEAD).toArrow()  # bounded by HEAD
    head = top.column("word").combine_chunks() if top.num_rows else pa.array([], pa.string())
    counts = top.column("n").to_numpy().astype(np.int64) if top.num_rows else np.zeros(0, np.int64)
    code = huffman([*counts.tolist(), max(ends, 1), max(all_words - int(counts.sum()), 1)])
    letters = totals(words.select("word").mapInArrow(_letters, PIECES), {0: PIECE}, salts)[0][:257]
    model = Model(head, counts, ends, code, huffman((letters + 1).tolist()))
    spelling = totals(words.select("word").mapInArrow(_spelling(model.letters), PIECES), {k: 2 << BYTE_BITS for k in range(INPUTS)}, salts)
    model.spelling = [_counts(spelling[k]) for k in range(INPUTS)]
    shared = spark.sparkContext.broadcast(model)
    tables = totals(texts.mapInArrow(_word_tables(shared), PIECES), {k: 2 << WORD_BITS for k in range(2)}, salts)
    shared.destroy()
    model.tables = [_counts(tables[k]) for k in range(2)]
    del tables
    shared = spark.sparkContext.broadcast(model)
    sums = totals(texts.mapInArrow(_learned(shared), PIECES), {0: PIECE}, salts)[0]
    moved, bits, seen = np.split(sums[:GATES * INPUTS + GATES + GATES * BINS * 2], [GATES * INPUTS, GATES * INPUTS + GATES])
    mixer = Mixer()
    mixer.fit(moved / 4096, bits, seen)
    return shared, mixer, words, int(all_words) + ends, int(distinct) + (ends > 0)


def report(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    rows = docs.select("doc_id", "text", held_out(docs["doc_id"]).alias("held_out"))
    shared, mixer, words, n, distinct = train(rows.filter("NOT held_out").select("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored, _ = stage(rows.select(F.monotonically_increasing_id().alias("row"), "doc_id", "held_out", "text").mapInArrow(
        _scored(shared, mixer, n, distinct),
        f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, base double, score double, bytes long, rare array<struct<word:string,times:long>>"), "scored")
    shared.destroy()
    rare = scored.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.times")
    found = rare.join(words, "word", "left").groupBy("row").agg(
        F.sum(F.col("times") * (F.log10(F.coalesce("n", F.lit(0)) + 1) - math.log10(n + distinct + 1))).alias("more"),
        F.sum(F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0)).alias("known_too"))
    return scored.join(found, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.coalesce("known_too", F.lit(0))).alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("more", F.lit(0.0))).alias("base_score"), "score",
        F.when(F.col("bytes") > 0, -F.col("score") / math.log10(2) / F.col("bytes")).alias("bits_per_byte"))
