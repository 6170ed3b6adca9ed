"""Encoding and decoding with a SentencePiece BPE model by shared-prefix dynamic programming.

A text becomes marked words: blanks belong to the word that follows them. No piece of
the model crosses from a letter to a blank or holds a line end, so words are encoded
alone. The distinct words of a batch are sorted, which lays them out as a trie walked
depth first: a word keeps the forward states of the prefix it shares with the word
before and adds states for its other characters only.

The model merges pairs (BPE), so the path with the best sum of scores, the usual state of
a Viterbi pass, is not what it encodes to. The state kept per prefix is therefore
the last piece of that prefix's own encoding. The piece that ends a longer prefix is the
one that starts where another prefix ends and is *compatible* with that prefix's last
piece: the two, written together, encode to just these two. Compatibility of a pair is
found by merging it once and is remembered. Characters without a piece are bytes; they
end a path, and the next one starts afresh.

Texts stay where they are: no row moves. A task remembers at most ``WORDS`` words.

Defined results: a null text counts as empty and has no pieces; the blank mark U+2581 in
a text is a blank, as in the model's own library; rows are independent, so repeated
rows give repeated results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from guardlake.llm.shared import in_arrow

MARK = "▁"
#: Words, pairs and merged strings that a task remembers before it starts over.
WORDS, PAIRS = 400_000, 2_000_000
WORD = re.compile(f"{MARK}*[^{MARK}\n]+|{MARK}+|\n")


class Codec:
    """One model in one task."""

    def __init__(self, model: str) -> None:
        from sentencepiece import SentencePieceProcessor
        model = SentencePieceProcessor(model_file=model)
        ids = range(model.get_piece_size())
        plain = [i for i in ids if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.of = {model.id_to_piece(i): i for i in plain}
        self.score = {i: model.get_score(i) for i in plain}
        self.text = {i: p for p, i in self.of.items()}
        self.byte = {int(model.id_to_piece(i)[3:5], 16): i for i in ids if model.is_byte(i)}
        self.raw = [b""] * len(ids)
        for i in plain:
            self.raw[i] = self.text[i].replace(MARK, " ").encode()
        for value, i in self.byte.items():
            self.raw[i] = bytes([value])
        self.pairs: dict[int, bool] = {}
        self.clear()
        # Finds the pieces that end at each place of a word; pieces that would not encode to themselves are left out.
        self.ending = ahocorasick.Automaton()
        for piece, i in self.of.items():
            if len(self.merged(list(piece))) == 1:
                self.ending.add_word(piece, (len(piece), i))
        self.ending.make_automaton()

    def clear(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.starts = np.empty(0, np.int32), np.zeros(1, np.int64)

    def merged(self, symbols: list[str]) -> list[str]:
        """The model's merges: always the pair with the best score, the leftmost of equals."""
        while True:
            best = None
            for k in range(len(symbols) - 1):
                i = self.of.get(symbols[k] + symbols[k + 1])
                if i is not None and (best is None or self.score[i] > best[0]):
                    best = self.score[i], k
            if best is None:
                return symbols
            k = best[1]
            symbols = [*symbols[:k], symbols[k] + symbols[k + 1], *symbols[k + 2:]]

    def compatible(self, a: int, b: int) -> bool:
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) > PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self.merged(list(self.text[a] + self.text[b])) == [self.text[a], self.text[b]]
        return known

    def learn(self, words: list[str]) -> None:
        """Encode new words in sorted order, reusing the states of shared prefixes."""
        states: list[tuple[int, int | None, list[int] | None]] = [(0, None, None)]  # begin of the last piece, its id, bytes instead
        before, flat, sizes = "", [], []
        for word in sorted(words):
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del states[shared + 1:]
            for last, (size, piece) in self.ending.iter(word):
                if last < shared or last + 1 < len(states):
                    continue  # a state of the prefix, or found already
                while len(states) <= last:
                    states.append(self.raw_state(word, len(states)))
                ahead = states[last + 1 - size][1]
                if last + 1 == size or ahead is None or self.compatible(ahead, piece):
                    states.append((last + 1 - size, piece, None))
            while len(states) <= len(word):
                states.append(self.raw_state(word, len(states)))
            path, at = [], len(word)
            while at:
                begin, piece, raw = states[at]
                path.extend(reversed(raw) if raw else [piece])
                at = begin
            flat.extend(reversed(path))
            sizes.append(len(path))
            self.index[word] = len(self.index)
            before = word
        self.flat = np.concatenate([self.flat, np.array(flat, np.int32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes, dtype=np.int64)])

    def raw_state(self, word: str, end: int) -> tuple[int, None, list[int]]:
        """The state after a character that no piece ends with: its bytes."""
        return end - 1, None, [self.byte[x] for x in word[end - 1].encode("utf-8", "replace")]

    def encoded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts end to end, and where each begins."""
        words, counts = [], []
        for text in texts:
            found = WORD.findall(MARK + text.replace(" ", MARK)) if text else []
            words += found
            counts.append(len(found))
        new = set(words).difference(self.index)
        if new:
            if len(self.index) + len(new) > WORDS:
                self.clear()
                new = set(words)
            self.learn(list(new))
        at = np.fromiter(map(self.index.__getitem__, words), np.int64, len(words))
        sizes = (self.starts[1:] - self.starts[:-1])[at]
        ends = np.concatenate([[0], np.cumsum(sizes)])
        take = np.repeat(self.starts[:-1][at] - ends[:-1], sizes) + np.arange(ends[-1])
        return self.flat[take], ends[np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)]

    def decoded(self, ids: list[int]) -> str:
        """The text of some ids: blanks for marks, bytes put together, without the first blank."""
        return b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")[1:]


_CODECS: dict[str, Codec] = {}


def codec(model: str) -> Codec:
    if model not in _CODECS:
        _CODECS[model] = Codec(model)
    return _CODECS[model]


def encode(docs: DataFrame, model: str) -> DataFrame:
    """Per row of (doc_id, text): doc_id, ids, n_tokens, round_trip (whether decoding gives the text back)."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                texts = [t or "" for t in batch.column("text").to_pylist()]
                ids, starts = use.encoded(texts)
                back = [use.decoded(ids[a:b].tolist()) == t.replace(MARK, " ") for a, b, t in zip(starts, starts[1:], texts)]
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts.astype(np.int32)), pa.array(ids, pa.int32())),
                    pa.array(np.diff(starts), pa.int64()), pa.array(back, pa.bool_())], names=["doc_id", "ids", "n_tokens", "round_trip"])
        use.clear()  # the worker may wait long for its next task

    return in_arrow(docs.select("doc_id", "text"), run, f"doc_id {kind}, ids array<int>, n_tokens long, round_trip boolean")


def decode(tokens: DataFrame, model: str) -> DataFrame:
    """Per row of (doc_id, ids): doc_id, text. Null ids give an empty text."""
    kind = tokens.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        use = codec(model)
        for batch in batches:
            texts = [use.decoded(ids or []) for ids in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return in_arrow(tokens.select("doc_id", "ids"), run, f"doc_id {kind}, text string")
