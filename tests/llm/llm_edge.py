import pytest
from pyspark.sql import functions as F

#: Names that operators use inside, and that a table may bring along.
CLASHING = ("size", "kept", "key", "n", "rep", "maybe", "block", "bitmap", "taken", "tree", "edits", "base", "c", "doc", "id", "hash",
            "again", "times", "stratum", "cells", "bucket", "label", "ids", "target", "value", "doc_id2", "bands", "keep_id", "payload")

LONG = " ".join(f"word{i % 977}" for i in range(20_000))


def edge_rows():
    texts = [None, "", " \n\t ", "one", "Same text here, five words.", "same TEXT here, five words.", "Same text here, five words.",
             "Éa É é ẞ ſ İ", LONG, LONG, "a b c d e " * 30, "x\n\ny\nx\n \nx", "password = 'hunter2hunter2'", "日本語 テキスト 😀", "\x00\x01 \x7f",
             "Released under the MIT License.\nmore words here to read, quite a few of them indeed"]
    rows = [(i, t, ("en", "de", None)[i % 3], ("s1", "s2", None, "")[i % 4]) for i, t in enumerate(texts)]
    return rows + [rows[4], rows[8], (None, "Same text here, five words.", "en", "s1"), (None, None, None, None), (7, "other text of the same id", "en", "s1")]


@pytest.fixture(scope="module")
def edge(spark):
    df = spark.createDataFrame(edge_rows(), "doc_id long, text string, lang string, source string")
    return df.select("*", F.length("text").cast("long").alias("n_chars"), *[F.lit("own").alias(c) for c in CLASHING]).cache()


@pytest.fixture(scope="module")
def empty(edge):
    return edge.filter("false")
