"""Candidate search over vectors: an inverted file of cells around centroids, probed per query, with exact scores.

1. Centroids are fitted by spherical k-means on a bounded sample (``SAMPLE`` vectors, a draw
   by hash of the id). Every vector is then put into the cell of its nearest centroid.
2. Large cells are cut into slices of about ``SLICE`` vectors, so a cell that holds most of
   the vectors still spreads over tasks.
3. A query probes the cells whose centroids are nearest to it. Queries of a cell are cut into
   parts too; a unit is a slice and a part, and its scores are one matrix product. Only the
   best k of each query and unit leave it, and a window picks the best k of the query.
4. ``probes_for`` finds the number of probes that a recall needs, from the exact neighbours of
   a bounded sample of queries: the recall for any number of probes follows from the rank of
   each neighbour's cell.
5. Probing all cells is the exact search. Then a query need not be sent to each cell: all of the index is cut into groups
   of about ``GROUP`` vectors, the queries into parts of about ``QUERIES``, and a unit is a group and a part. All pairs
   are compared, which is quadratic; a unit holds a tile of scores at a time and the best k of each query.

Scores are cosines in double precision; equal scores (to six digits) go to the least id. A
null vector, one of zero length or one of another dimension than most is in no cell and
finds nothing; rows that repeat an id are separate candidates; an empty table finds nothing.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from guardlake.spark import kept

SAMPLE, SLICE, PART = 20_000, 4096, 1024
GROUP, QUERIES = 32_768, 16_384
#: Queries and vectors whose scores are worked out at once.
TILE = 256, 4096
MOST_CELLS = 4096
ROWS = "id long, vector array<double>"


def _units(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers of the vectors of this dimension that have a direction, and their unit vectors."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.array([-1 if n is None else n for n in pc.list_value_length(column).to_pylist()], np.int64)
    rows = np.flatnonzero(sizes == dim)
    flat = column.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    units = np.nan_to_num(flat, nan=0.0).reshape(len(rows), dim)
    norms = np.sqrt((units * units).sum(axis=1))
    some = norms > 0
    return rows[some], units[some] / norms[some][:, None]


@dataclass
class Index:
    """``table`` has (id, vector, cell, slice); the other fields are of bounded size: cells and their slices."""

    table: DataFrame
    centroids: np.ndarray
    slices: dict[int, int]


def fit(vectors: DataFrame, cells: int | None = None, sample: int = SAMPLE, rounds: int = 12) -> np.ndarray:
    """Unit centroids, from at most about ``sample`` vectors. ``vectors``: id, vector."""
    sizes = vectors.filter(F.size("vector") > 0).groupBy(F.size("vector").alias("d")).count()
    first = sizes.orderBy(F.desc("count"), "d").first()
    if first is None:
        return np.zeros((0, 0))
    n = first["count"]
    share = min(1.0, sample / max(n, 1))
    drawn = vectors.filter(F.pmod(F.xxhash64("id", F.lit(5)), F.lit(1_000_000)) < math.ceil(share * 1e6)).select("id", "vector").orderBy("id").toArrow()
    _, units = _units(drawn.column("vector"), first["d"])
    if not len(units):
        return np.zeros((0, first["d"]))
    cells = min(len(units), cells or min(MOST_CELLS, max(1, round(math.sqrt(n)))))
    centroids = units[np.random.default_rng(7).permutation(len(units))[:cells]].copy()
    for _ in range(rounds):
        nearest = _nearest(units, centroids, 1)[:, 0]
        sums = np.zeros_like(centroids)
        np.add.at(sums, nearest, units)
        norms = np.sqrt((sums * sums).sum(axis=1))
        moved = np.where(norms[:, None] > 0, sums / np.maximum(norms, 1e-12)[:, None], centroids)
        if np.allclose(moved, centroids, atol=1e-9):
            break
        centroids = moved
    return centroids


def _nearest(units: np.ndarray, centroids: np.ndarray, probes: int) -> np.ndarray:
    """Per unit vector the cells in order of nearness, the least number first among equals."""
    out = np.empty((len(units), min(probes, len(centroids))), np.int64)
    for at in range(0, len(units), 2048):
        scores = np.round(units[at:at + 2048] @ centroids.T, 9)
        if out.shape[1] == 1:
            out[at:at + 2048, 0] = scores.argmax(axis=1)
            continue
        out[at:at + 2048] = np.argsort(-scores, axis=1, kind="stable")[:, :probes]
    return out


def build(vectors: DataFrame, centroids: np.ndarray) -> Index:
    """All vectors in their cells, as a written table."""
    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                rows, units = _units(part.column("vector"), centroids.shape[1])
                flat = pa.array(units.reshape(-1))
                ends = pa.array(np.arange(len(rows) + 1) * centroids.shape[1], pa.int32())
                yield pa.RecordBatch.from_arrays([part.column("id").take(pa.array(rows)), pa.ListArray.from_arrays(ends, flat),
                                                  pa.array(_nearest(units, centroids, 1)[:, 0] if len(rows) else np.zeros(0, np.int64))], names=["id", "vector", "cell"])

    spark = vectors.sparkSession
    if not len(centroids):
        return Index(spark.createDataFrame([], f"{ROWS}, cell long, slice long"), centroids, {})
    placed = kept(vectors.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(assign, f"{ROWS}, cell long"))
    slices = {r["cell"]: max(1, -(-r["count"] // SLICE)) for r in placed.groupBy("cell").count().collect()}  # at most MOST_CELLS rows
    cut = F.element_at(F.create_map(*[F.lit(x).cast("long") for kv in sorted(slices.items()) for x in kv]), F.col("cell")) if slices else F.lit(1)
    return Index(placed.withColumn("slice", F.pmod(F.xxhash64("id"), cut)), centroids, slices)


FOUND = "query_id long, id long, score double, probe int"


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    return table.column("vector").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, width)


def _best(wanted: np.ndarray, given: np.ndarray, ids: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best k of each wanted row among the given ones: rows of both, and scores; equal scores go to the least id, a null id first."""
    known, number = ids.is_valid().to_numpy(), pc.fill_null(ids, 0).to_numpy()
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for at in range(0, len(wanted), TILE[0]):
        some = wanted[at:at + TILE[0]]
        who, which, score = out[0]
        least = np.full(len(some), -2.0)  # a score that the k-th best reaches, so far
        for low in range(0, len(given), TILE[1]):
            scores = some @ given[low:low + TILE[1]].T
            if low == 0 and scores.shape[1] > k:
                least = np.round(np.partition(scores, -k, axis=1)[:, -k], 6)
            row, column = np.nonzero(scores >= least[:, None] - 1e-6)
            who, which, score = (np.concatenate(x) for x in ((who, row), (which, column + low), (score, np.round(scores[row, column], 6))))
            if len(who) > 4 * k * len(some) or low + TILE[1] >= len(given):
                order = np.lexsort((number[which], known[which], -score, who))
                first = np.searchsorted(who[order], np.arange(len(some)))
                place = np.arange(len(order)) - first[who[order]]
                order, place = order[place < k], place[place < k]
                who, which, score = who[order], which[order], score[order]
                least[who[place == k - 1]] = score[place == k - 1]
        out.append((who + at, which, score))
    return tuple(np.concatenate(x) for x in zip(*out))


def search(index: Index, queries: DataFrame, k: int = 10, probes: int | None = None) -> DataFrame:
    """The best k of each query (id, vector) among the cells it probes (None: all, which is exact): query_id, id, score, rank, probe.

    ``probe`` is the place of the neighbour's cell in the query's order of cells, from 1.
    """
    centroids, slices = index.centroids, index.slices
    spark = queries.sparkSession
    if not slices:
        return spark.createDataFrame([], "query_id long, id long, score double, rank int, probe int")
    probes = min(probes or len(centroids), len(centroids))
    if probes == len(centroids):
        return _search_all(index, queries, k)
    width, counts = centroids.shape[1], np.array([slices.get(c, 0) for c in range(len(centroids))])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A row per query and slice of each cell that it probes."""
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                rows, units = _units(part.column("vector"), width)
                if not len(rows):
                    continue
                cells = _nearest(units, centroids, probes)
                n = counts[cells]
                who, place = np.repeat(np.arange(len(rows)), n.sum(axis=1)), np.repeat(np.tile(np.arange(1, probes + 1), len(rows)), n.reshape(-1))
                cell = np.repeat(cells.reshape(-1), n.reshape(-1))
                first = np.cumsum(n.reshape(-1)) - n.reshape(-1)
                slice_ = np.arange(len(cell)) - np.repeat(first, n.reshape(-1))
                ends = pa.array(np.arange(len(cell) + 1) * width, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(rows[who])), pa.ListArray.from_arrays(ends, pa.array(units[who].reshape(-1))),
                     pa.array(cell), pa.array(slice_), pa.array(place, pa.int32())], names=["id", "vector", "cell", "slice", "probe"])

    asked = queries.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(ask, f"{ROWS}, cell long, slice long, probe int")
    asked = kept(asked)
    parts = asked.groupBy("cell", "slice").count().select("cell", "slice", F.ceil(F.col("count") / PART).alias("parts"))
    asked = asked.join(parts, ["cell", "slice"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts"))).drop("parts")
    rows = index.table.join(parts, ["cell", "slice"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1))).drop("parts")

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, given, ids = _matrix(left, width), _matrix(right, width), right.column("id")
        who, which, score = _best(wanted, given, ids, k)
        return pa.table([left.column("id").take(pa.array(who)), ids.take(pa.array(which)), pa.array(score), left.column("probe").take(pa.array(who))],
                        names=["query_id", "id", "score", "probe"])

    keys = ("cell", "slice", "part")
    found = asked.groupBy(*keys).cogroup(rows.groupBy(*keys)).applyInArrow(best, FOUND)
    return _ranked(found, k)


def _search_all(index: Index, queries: DataFrame, k: int) -> DataFrame:
    """The best k of each query among all vectors of the index."""
    centroids, width = index.centroids, index.centroids.shape[1]

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, units = _units(batch.column("vector"), width)
            ends = pa.array(np.arange(len(rows) + 1) * width, pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(rows)), pa.ListArray.from_arrays(ends, pa.array(units.reshape(-1)))], names=["id", "vector"])

    def best(left: pa.Table, right: pa.Table) -> pa.Table:
        wanted, given, ids = _matrix(left, width), _matrix(right, width), right.column("id")
        who, which, score = _best(wanted, given, ids, k)
        cell, probe = right.column("cell").to_numpy()[which], np.empty(len(who), np.int32)
        for at in range(0, len(who), 1024):
            one, own = who[at:at + 1024], cell[at:at + 1024, None]
            near = np.round(wanted[one] @ centroids.T, 9)
            mine = np.take_along_axis(near, own, 1)
            probe[at:at + 1024] = 1 + (near > mine).sum(axis=1) + ((near == mine) & (np.arange(len(centroids)) < own)).sum(axis=1)
        return pa.table([left.column("id").take(pa.array(who)), ids.take(pa.array(which)), pa.array(score), pa.array(probe)], names=["query_id", "id", "score", "probe"])

    asked = kept(queries.select(F.col("id").cast("long").alias("id"), "vector").mapInArrow(unit, ROWS))
    groups, parts = max(1, -(-index.table.count() // GROUP)), max(1, -(-asked.count() // QUERIES))
    each = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    # The vector counts in the hash as well, so that rows which repeat an id spread.
    asked = asked.withColumn("part", F.pmod(F.xxhash64("id", "vector", F.lit(3)), F.lit(parts).cast("long"))).withColumn("unit", each(groups))
    rows = index.table.withColumn("unit", F.pmod(F.xxhash64("id", "vector", F.lit(4)), F.lit(groups).cast("long"))).select(
        "id", "vector", "cell", "unit", each(parts).alias("part"))
    return _ranked(asked.groupBy("unit", "part").cogroup(rows.groupBy("unit", "part")).applyInArrow(best, FOUND), k)


def _ranked(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "id", "score", "rank", "probe")


def probes_for(index: Index, queries: DataFrame, k: int = 10, recall: float = 0.95, sample: int = 256) -> int:
    """The fewest probes with which a sample of queries finds that share of its exact neighbours."""
    n = queries.count()
    drawn = queries.filter(F.pmod(F.xxhash64("id", F.lit(6)), F.lit(1_000_000)) < math.ceil(1e6 * min(1.0, sample / max(n, 1))))
    ranks = search(index, drawn, k).groupBy("probe").count().orderBy("probe").collect()  # at most a row per cell
    total, seen = sum(r["count"] for r in ranks), 0
    for r in ranks:
        seen += r["count"]
        if seen >= recall * total:
            return r["probe"]
    return max(1, len(index.centroids))
