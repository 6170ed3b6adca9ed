"""The vector index against exact search by plain numpy."""

import numpy as np
import pytest

from guardlake.operators import vector_index as V
from guardlake.plans.registry import all_queries

FOLDER = "/root/testdata/sf0.1"


def exact(rows, wanted, k):
    ids = np.array([i for i, _ in rows])
    units = np.array([v for _, v in rows], float)
    units /= np.linalg.norm(units, axis=1)[:, None]
    out = {}
    for i in wanted:
        scores = np.round(units @ units[np.flatnonzero(ids == i)[0]], 6)
        out[i] = [int(ids[j]) for j in np.lexsort((ids, -scores))[:k]]
    return out


def by_query(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r["query_id"], r["rank"])):
        out.setdefault(r["query_id"], []).append(r["id"])
    return out


def test_recall_of_the_registered_query(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{FOLDER}/embeddings.parquet").collect()]
    want = exact(rows, [i for i, _ in rows if i % 20 == 0], 10)
    got = by_query(all_queries()["retrieve_index"](spark, FOLDER))
    assert set(got) == set(want) and all(len(x) == 10 for x in got.values())
    assert np.mean([len(set(got[i]) & set(want[i])) / 10 for i in want]) >= 0.9


@pytest.fixture(scope="module")
def clustered(spark):
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(8, 12))
    rows = [(i, (centers[0 if i % 3 == 0 else i % 8] + 0.3 * rng.normal(size=12)).tolist()) for i in range(1200)]
    return rows, spark.createDataFrame(rows, V.ROWS)


def test_probing_all_cells_is_exact_and_few_are_enough(spark, clustered, monkeypatch):
    monkeypatch.setattr(V, "SLICE", 64)  # the hot cell is cut
    monkeypatch.setattr(V, "PART", 16)
    rows, vectors = clustered
    index = V.build(vectors, V.fit(vectors, cells=10))
    assert max(index.slices.values()) > 1 and index.table.count() == len(rows)
    queries = vectors.filter("id % 20 = 0")
    want = exact(rows, [i for i, _ in rows if i % 20 == 0], 5)
    assert by_query(V.search(index, queries, 5)) == want
    probes = V.probes_for(index, queries, 5, recall=0.9)
    assert probes < 10
    got = by_query(V.search(index, queries, 5, probes))
    assert np.mean([len(set(got[i]) & set(want[i])) / 5 for i in want]) >= 0.9


def test_odd_vectors(spark, clustered):
    rows, vectors = clustered
    odd = [(5000, None), (5001, [0.0] * 12), (5002, [1.0]), (5003, []), (None, rows[3][1]), (3, rows[3][1])]
    both = vectors.unionByName(spark.createDataFrame(odd, V.ROWS))
    index = V.build(both, V.fit(both, cells=10))
    assert index.table.count() == len(rows) + 2
    got = by_query(V.search(index, spark.createDataFrame([(1, rows[3][1]), (2, None), (4, [0.0] * 12)], V.ROWS), 3))
    assert list(got) == [1] and got[1].count(3) == 2 and None in got[1]


def test_no_vectors(spark):
    none = spark.createDataFrame([], V.ROWS)
    index = V.build(none, V.fit(none))
    assert V.search(index, none).count() == 0 and V.probes_for(index, none) == 1


def test_exact_search_sends_a_query_once_to_a_group_of_cells(spark, monkeypatch):
    """Many equal scores over several groups, parts and tiles; what is sent does not grow with the number of cells."""
    rng = np.random.default_rng(4)
    rows = [(i, rng.integers(-1, 2, 6).astype(float).tolist()) for i in range(900)]
    rows = [(i, v if any(v) else [1.0] * 6) for i, v in rows]
    vectors = spark.createDataFrame(rows, V.ROWS)
    monkeypatch.setattr(V, "GROUP", 300)
    monkeypatch.setattr(V, "QUERIES", 40)
    monkeypatch.setattr(V, "TILE", (16, 64))
    index, kept, sent = V.build(vectors, V.fit(vectors, cells=30)), V.kept, []

    def counting(df):
        out = kept(df)
        sent.append(out.count())
        return out

    monkeypatch.setattr(V, "kept", counting)
    queries = vectors.filter("id % 10 = 0")
    got = V.search(index, queries, 7).collect()
    assert max(sent) <= 90  # a row per query, not per query and cell
    want = exact(rows, [i for i, _ in rows if i % 10 == 0], 7)
    found = {}
    for r in sorted(got, key=lambda r: (r["query_id"], r["rank"])):
        found.setdefault(r["query_id"], []).append(r["id"])
    assert found == want
    units = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    cells = {r["id"]: r["cell"] for r in index.table.collect()}
    for r in got[:100]:
        assert V._nearest(units[r["query_id"]][None], index.centroids, 30)[0, r["probe"] - 1] == cells[r["id"]]
