"""The Merkle manifest and the ranking below it against plain Python."""

import random

import brute
from compare import compare, views
from llm_edge import edge_rows
from pyspark.sql import functions as F

from guardlake.llm import merkle, queries, ranking, sql

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def test_places_in_groups(spark):
    rows = [("a" if i % 3 else "b", random.Random(i).randrange(50), i) for i in range(900)]
    got = ranking.placed(spark.createDataFrame(rows, "g string, x int, i int").repartition(7), "g", ["x", "i"]).collect()
    want = {i: at for g in "ab" for at, (_, i) in enumerate(sorted((x, i) for h, x, i in rows if h == g))}
    assert {r["i"]: r["at"] for r in got} == want


def test_manifest_of_odd_rows(edge, empty):
    want = brute.merkle([(i, s, g, None if t is None else len(t), t) for i, t, g, s in edge_rows()])
    got = rows_of(merkle.manifest(edge, merkle.lowered(edge)))
    assert got == want
    assert {v for *_, v in got} == {True, False}
    assert merkle.manifest(empty, merkle.lowered(empty)).count() == 0


def test_manifest_over_several_superblocks(spark):
    docs = spark.range(9000).select(
        F.col("id").alias("doc_id"), F.when(F.col("id") % 900 > 4, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 900 + F.col("id") / 900)).alias("source"),
        F.lit("en").alias("lang"), F.lit(3).cast("long").alias("n_chars"), F.concat(F.lit("Text "), F.col("id")).alias("text"))
    want = brute.merkle([tuple(r) for r in docs.collect()])
    assert rows_of(merkle.manifest(docs, merkle.lowered(docs))) == want


def test_lone_document(spark):
    docs = spark.createDataFrame([(1, None, None, None, None)], "doc_id long, source string, lang string, n_chars long, text string")
    row = merkle.manifest(docs, docs["text"]).first()
    assert row["leaf"] == row["subroot"] == row["root"] == row["folded_root"] and row["verified"]


def test_manifest_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    assert compare(spark, views(folder), folder, queries.op13_merkle, sql.SQL["op13_merkle"])[0] == "ok"
