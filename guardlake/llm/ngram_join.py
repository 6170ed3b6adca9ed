"""Near-duplicate join: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

1. Each text becomes its set of shingle hashes and a MinHash signature, cut into bands.
   Bands and rows are chosen for a target recall at the threshold (``banding``).
   Documents with equal sets are one class; all later steps work on classes.
2. Band hashes are counted. A bucket of two classes or more makes candidates, and only
   entries that may be in one (by a Bloom filter) shuffle with their class.
3. Candidates are compared in units, so that a pair meets once and a set is sent to few
   places: each class has a home, the largest of its buckets; large homes are split into
   cells. A unit is a pair of cells that meet in some bucket, and holds the members that
   do. Full sets are compared there by matrix products over the shared shingles.
   A unit returns a row per member, not its pairs: links found, and the least member
   that it is connected with.
4. Groups are the connected components over those rows: least labels spread along them
   until none changes.

A group of g texts that are all alike costs g * g / 2 comparisons, spread over units,
but only rows in proportion to g. No bucket is capped.

Defined results: words are runs of anything but space and characters 9 to 13; a text of
one to four words has one shingle, all its words; a text without words (or null) links
to nothing; copies link to each other; rows that repeat a doc_id are told apart by their
text; the least doc_id names a class or a group, and null only where there is no other;
an empty table gives no rows; further columns are carried along and never read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake.llm import bloom
from guardlake.llm.shared import drop, in_arrow, packed, stage

SHINGLE = 5
#: A cell holds at most about so many classes, and so many shingles.
CELL_CLASSES, CELL_SHINGLES = 1024, 1 << 21


def banding(threshold: float = 0.8, recall: float = 0.999, hashes: int = 128) -> tuple[int, int]:
    """(bands, rows): the most rows a band for which enough bands to reach the recall at the threshold fit into the hashes."""
    best = None
    for rows in range(1, hashes + 1):
        bands = math.ceil(math.log(1 - recall) / math.log1p(-(threshold ** rows)))
        if bands * rows > hashes:
            break
        best = bands, rows
    if best is None:
        raise ValueError("too few hashes for this recall")
    return best


def _mixed(x: np.ndarray) -> np.ndarray:
    """Spread 64-bit values evenly."""
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


def shingles(texts: pa.Array) -> list[np.ndarray]:
    """The sorted shingle hashes of each text."""
    texts = pc.fill_null(texts, "")
    if pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.string())
    lists = pc.ascii_split_whitespace(texts)
    flat, ends = lists.flatten(), lists.offsets.to_numpy().astype(np.int64) - lists.offsets[0].as_py()
    real = pc.greater(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    ends = np.concatenate([[0], np.cumsum(real)])[ends]
    coded = flat.filter(pa.array(real)).dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    known = np.fromiter((xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(coded.dictionary))
    words = known[coded.indices.to_numpy()] if len(coded) else np.empty(0, np.uint64)
    runs = np.zeros(max(len(words) - SHINGLE + 1, 0), np.uint64)
    for i in range(SHINGLE):
        runs = _mixed(runs + words[i:i + len(runs)] * np.uint64(2 * i + 1)) if len(runs) else runs
    out = []
    for a, b in zip(ends[:-1], ends[1:]):
        if b - a >= SHINGLE:
            out.append(np.unique(runs[a:b - SHINGLE + 1]))
        elif b > a:
            one = np.zeros(1, np.uint64)
            for w in words[a:b]:
                one = _mixed(one * np.uint64(3) + w)
            out.append(one)
        else:
            out.append(np.empty(0, np.uint64))
    return out


def _key(grams: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(grams.tobytes())


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _signer(bands: int, rows: int):
    rng = np.random.default_rng(20240501)
    salts = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None]
    odds = rng.integers(0, 1 << 63, bands * rows, dtype=np.uint64)[:, None] * np.uint64(2) + np.uint64(1)
    places = _mixed(np.arange(1, bands + 1, dtype=np.uint64))

    def signature(grams: np.ndarray) -> np.ndarray:
        least = np.full(bands * rows, np.iinfo(np.uint64).max, np.uint64)
        for at in range(0, len(grams), 4096):
            least = np.minimum(least, ((grams[None, at:at + 4096] ^ salts) * odds).min(axis=1))
        table, out = least.reshape(bands, rows), places.copy()
        for r in range(rows):
            out = _mixed(out * np.uint64(5) + table[:, r])
        return out.view(np.int64)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            sets = shingles(batch.column("text"))
            signed = [signature(g) if len(g) else np.empty(0, np.int64) for g in sets]
            ends = np.concatenate([[0], np.cumsum([len(s) for s in signed])]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"), pa.array([_key(g) for g in sets], pa.binary()), pa.array([len(g) for g in sets], pa.int32()),
                pa.ListArray.from_arrays(ends, np.concatenate(signed) if signed else np.empty(0, np.int64))],
                names=["doc_id", "text_hash", "key", "n", "bands"])

    return sign


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in _slices(batches):
        sets = shingles(batch.column("text"))
        yield pa.RecordBatch.from_arrays([pa.array([_key(g) for g in sets], pa.binary()), pa.array([g.tobytes() for g in sets], pa.binary())], names=["key", "grams"])


def text_hash(docs: DataFrame) -> Column:
    return F.sha2(F.coalesce(docs["text"], F.lit("")), 256)


def _jaccard(sets: list[np.ndarray]) -> np.ndarray:
    """Similarities of all pairs of sets: shared shingles are counted by products of 0/1 blocks."""
    m, sizes = len(sets), np.array([len(s) for s in sets])
    wide = sizes.astype(np.float32)
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(m), sizes)
    order = np.argsort(values, kind="stable")
    values, owner = values[order], owner[order]
    new = np.concatenate([[True], values[1:] != values[:-1]])
    column = np.cumsum(new) - 1
    often = np.bincount(column) > 1
    keep = often[column]
    owner, column = owner[keep], (np.cumsum(often) - 1)[column[keep]]
    shared = np.zeros((m, m), np.float32)
    width = 4096
    cuts = np.searchsorted(column, np.arange(0, (column[-1] if len(column) else -1) + 1 + width, width))
    for i, (a, b) in enumerate(zip(cuts[:-1], cuts[1:])):
        if b > a:
            block = np.zeros((m, min(width, column[b - 1] - i * width + 1)), np.float32)
            block[owner[a:b], column[a:b] - i * width] = 1
            shared += block @ block.T
    either = wide[:, None] + wide[None, :]
    either -= shared
    return np.divide(shared, either, out=shared)


def _compare(threshold: float):
    def unit_rows(keys: list, cells: np.ndarray, sizes: np.ndarray, grams: list, within: bool) -> tuple[np.ndarray, list]:
        near = _jaccard([np.frombuffer(g, np.uint64) for g in grams]) >= threshold - 1e-6
        np.fill_diagonal(near, False)
        if not within:
            near &= cells[:, None] != cells[None, :]
        links = np.array([sizes[row].sum() for row in near])
        root = np.full(len(keys), -1)
        for start in sorted(range(len(keys)), key=keys.__getitem__):  # components of the unit, each named by its least key
            if root[start] < 0:
                todo, root[start] = [start], start
                while todo:
                    reached = near[todo].any(axis=0) & (root < 0)
                    root[reached] = start
                    todo = list(np.flatnonzero(reached))
        return links, [keys[r] for r in root]

    def compare(group: pd.DataFrame) -> pd.DataFrame:
        out = []
        for (low, high), rows in group.groupby(["low", "high"], sort=False):
            if len(rows) > 1:
                keys = rows["key"].tolist()
                links, roots = unit_rows(keys, rows["cell"].to_numpy(), rows["size"].to_numpy(), rows["grams"].tolist(), low == high)
                found = links > 0
                out.append(pd.DataFrame({"key": np.array(keys, object)[found], "links": links[found].astype(np.int64), "root": np.array(roots, object)[found]}))
        return pd.concat(out) if out else pd.DataFrame({"key": [], "links": [], "root": []}, dtype=object)

    return compare


def components(edges: DataFrame) -> DataFrame:
    """(key, label) for edges (key, root): least labels along edges, then along labels, until none changes."""
    spark = edges.sparkSession
    both = edges.select(F.col("key").alias("a"), F.col("root").alias("b")).filter("a <> b")
    both, _ = stage(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels, path = stage(both.select(F.col("a").alias("key"), F.col("a").alias("label")).distinct(), "labels")
    while True:
        ahead = labels.select(F.col("key").alias("b"), F.col("label").alias("seen"))
        least = both.join(ahead, "b").groupBy(F.col("a").alias("key")).agg(F.min("seen").alias("least"))
        lower = labels.join(least, "key").select("key", F.col("label").alias("was"), F.least("label", "least").alias("label"))
        lower, low_path = stage(lower, "labels")
        jump = lower.select(F.col("key").alias("label"), F.col("label").alias("far"))
        moved, new_path = stage(lower.join(jump, "label").select("key", "was", F.least("label", "far").alias("label")), "labels")
        drop(spark, path, low_path)
        labels, path = moved.select("key", "label"), new_path
        if not moved.filter("label <> was").take(1):
            return labels


def classes_of(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> tuple[DataFrame, DataFrame]:
    """Signatures (doc_id, text_hash, key, n, ...) and, per class with words: key, size, links, class_id."""
    bands, rows = banding(threshold, recall)
    kind = docs.schema["doc_id"].dataType.simpleString()
    read = docs.select("doc_id", text_hash(docs).alias("text_hash"), "text")
    signed, _ = stage(in_arrow(read, _signer(bands, rows), f"doc_id {kind}, text_hash string, key binary, n int, bands array<bigint>"), "signed")
    classes, classes_at = stage(signed.filter("n > 0").groupBy("key").agg(
        F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("size"), F.first("n").alias("n"), F.first("bands").alias("bands")), "classes")

    spark = docs.sparkSession
    entries = classes.select("key", "rep", "size", "n", F.explode("bands").alias("bucket"))
    buckets, buckets_at = stage(entries.groupBy("bucket").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "buckets")
    shared = bloom.tested(entries, "bucket", bloom.repeated(buckets, "bucket", buckets.count(), least=1)).filter("maybe").drop("maybe")
    members, members_at = stage(shared.join(buckets, "bucket"), "members")
    homes = members.groupBy("key").agg(F.max(F.struct("m", "bucket"))["bucket"].alias("home"), *[F.first(c).alias(c) for c in ("rep", "size", "n")])
    cut = homes.groupBy("home").agg(F.ceil(F.greatest(F.count(F.lit(1)) / CELL_CLASSES, F.sum("n") / CELL_SHINGLES)).alias("cells"))
    cut, cut_at = stage(cut, "cut")
    cells, cells_at = stage(homes.join(cut, "home").select(
        "key", "rep", "size", F.xxhash64("home", F.pmod(F.xxhash64("key"), F.col("cells"))).alias("cell")), "cells")
    placed, placed_at = stage(members.select("key", "bucket").join(cells.select("key", "size", "cell"), "key"), "placed")
    drop(spark, buckets_at, members_at, cut_at)
    present, present_at = stage(placed.select("bucket", F.col("cell").alias("other")).distinct(), "present")
    units = placed.join(present, "bucket").select(
        "key", "size", "cell", F.least("cell", "other").alias("low"), F.greatest("cell", "other").alias("high")).distinct()
    units, units_at = stage(units, "units")
    drop(spark, placed_at, present_at)

    filter_ = bloom.repeated(cells, "rep", cells.count(), least=1)
    texts = bloom.tested(docs.select("doc_id", "text"), "doc_id", filter_).filter(F.col("maybe") | F.col("doc_id").isNull())
    sets = in_arrow(texts.select("text"), _sets, "key binary, grams binary").dropDuplicates(["key"])
    bins = max(1, math.ceil(units.count() / 2000))
    work = units.join(sets, "key").withColumn("bin", F.pmod(F.xxhash64("low", "high"), F.lit(bins)))
    results, _ = stage(work.groupBy("bin").applyInPandas(_compare(threshold), "key binary, links long, root binary"), "links")
    drop(spark, units_at)

    # Only classes with links need names: any other is a group of its own.
    labels = components(results.select("key", "root"))
    links = results.groupBy("key").agg(F.sum("links").alias("links"))
    linked, linked_at = stage(cells.select("key", "rep", "size").join(links, "key").join(labels, "key"), "linked")
    names = linked.groupBy("label").agg(F.min("rep").alias("class_id"), F.sum("size").alias("group_size"))
    named, _ = stage(linked.join(names, "label").select("key", "links", "class_id", "group_size"), "named")
    known, _ = stage(classes.select("key", "rep", "size").join(named, "key", "left").select(
        "key", "size", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class_id", "rep").alias("class_id"),
        F.coalesce("group_size", "size").alias("group_size")), "known")
    drop(spark, classes_at, cells_at, linked_at)
    return signed, known


def report(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """Per document: doc_id, class_id (its group's least doc_id), n_links (documents at or above the threshold), group_size."""
    signed, known = classes_of(docs, threshold, recall)
    rows = signed.select("doc_id", "n", "key").join(known, "key", "left")
    return rows.select("doc_id", F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
                       F.when(F.col("n") > 0, F.col("links") + F.col("size") - 1).otherwise(0).cast("long").alias("n_links"),
                       F.when(F.col("n") > 0, F.col("group_size")).otherwise(1).cast("long").alias("group_size"))


def one_of_each(docs: DataFrame, threshold: float = 0.8, recall: float = 0.999) -> DataFrame:
    """One document of each group, the one with the least doc_id, with its columns as they are.

    Only documents that may belong to a group of two or more (by a Bloom filter) shuffle.
    """
    signed, known = classes_of(docs, threshold, recall)
    grouped = signed.select("doc_id", "text_hash", "key").join(known.filter("group_size > 1"), "key")
    first = grouped.groupBy("class_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "text_hash")).alias("first"))
    first, _ = stage(first, "first")
    # A class_id is its group's least doc_id, so the pair (doc_id, text) that stays is found without joining the group.
    ids, _ = stage(grouped.select("doc_id", "text_hash").distinct(), "grouped")
    stay = first.select(F.col("first.doc_id").alias("doc_id"), F.col("first.text_hash").alias("text_hash"), F.lit(True).alias("stays"))
    verdicts = ids.join(stay, ids["doc_id"].eqNullSafe(stay["doc_id"]) & (ids["text_hash"] == stay["text_hash"]), "left").select(
        ids["doc_id"].alias("of"), ids["text_hash"].alias("of_text"), F.coalesce("stays", F.lit(False)).alias("stays"))
    verdicts, _ = stage(verdicts, "verdicts")
    filter_ = bloom.repeated(verdicts, "of_text", verdicts.count(), least=1)
    filter_ = stage(filter_[0], "filter")[0], filter_[1]
    rows = bloom.tested(packed(docs, id=docs["doc_id"], hash=text_hash(docs)), "hash", filter_)
    some = rows.filter("maybe").join(verdicts, F.col("id").eqNullSafe(F.col("of")) & (F.col("hash") == F.col("of_text")), "left")
    some = some.filter("stays IS NULL OR stays")
    again = F.row_number().over(Window.partitionBy("id", "hash").orderBy("hash"))
    some = some.withColumn("again", again).filter("again = 1")
    return rows.filter(~F.col("maybe")).select("doc.*").unionByName(some.select("doc.*"))
