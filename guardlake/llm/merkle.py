"""A Merkle manifest of a dataset: a leaf per document, a tree per source, a tree over sources, and a proof per document.

A leaf is the SHA-256 of the document's fields. The leaves of a source, by doc_id, are
hashed in runs of ``FAN`` until one node is left, the subroot; the subroots, by source,
likewise give the root. A proof is what is needed besides a leaf to compute the root.

1. Leaves get their place in their source (``ranking.placed``: ranges and counts, no
   source in one task). ``FAN ** DEPTH`` leaves make a superblock, whose node is an
   aggregate over the leaves.
2. The nodes of superblocks, few, are hashed level by level up to the root (``climb``), and
   the siblings on the way are handed down again (``descend``).
3. Leaves and the outer nodes they need are cogrouped by superblock: a group reduces its
   leaves, joins its own siblings with the outer ones to a proof per leaf, and folds the
   proof over the leaf of the table as it is now, tampered or not.

A group has at most 4,096 leaves, and as many outer nodes as the tree has levels.

Defined results: a null field counts as ``-``; leaves with a null doc_id come first, and
leaves of one doc_id stand by their hash; of rows that repeat as a whole each has a leaf
of its own and they share out the places; a null source is a source of its own and the
first, apart from an empty one; a lone leaf is its subroot, a lone subroot the root; texts
of any length are hashed whole where they are read and never shuffled; an empty table
gives no rows; further columns are never read.
"""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.exact_dedup import UPPER
from guardlake.llm.ranking import placed
from guardlake.llm.shared import let, stage

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
FAN, DEPTH = 16, 3
BLOCK = FAN ** DEPTH


def digest(*fields: Column) -> Column:
    """The leaf: per field ``-`` or its length in bytes, a colon and its value."""
    parts = [F.coalesce(F.concat(F.octet_length(f.cast("string")).cast("string"), F.lit(":"), f.cast("string")), F.lit("-")) for f in fields]
    return F.sha2(F.concat(*parts), 256)


def leaves(docs: DataFrame, tampered: Column) -> DataFrame:
    """doc_id, tree (the source, never null, in order), leaf, and ``now``: the leaf with ``tampered`` for a text."""
    return docs.select("doc_id", F.coalesce(F.concat(F.lit("s"), docs["source"]), F.lit("")).alias("tree"),
                       digest(*[docs[f] for f in FIELDS]).alias("leaf"),
                       digest(*[docs[f] for f in FIELDS if f != "text"], tampered).alias("now"))


def lowered(docs: DataFrame) -> Column:
    """The text as the contract tampers with it: A-Z lowered where 5 divides the crc32 of the doc_id."""
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return F.when(hit, F.translate(docs["text"], UPPER, UPPER.lower())).otherwise(docs["text"])


def _up(nodes: Column) -> Column:
    """One level of an array of nodes."""
    runs = F.sequence(F.lit(0), F.floor((F.size(nodes) - 1) / FAN).cast("int"))
    return F.transform(runs, lambda r: F.sha2(F.array_join(F.slice(nodes, r * FAN + 1, FAN), ""), 256))


def blocks(ranked: DataFrame) -> DataFrame:
    """Per superblock: tree, pos, n (nodes of its tree on this level), node. A superblock that is a whole tree stops at one node."""
    block = F.floor(F.col("at") / BLOCK).cast("long")
    sized = ranked.groupBy("tree").agg((F.floor(F.max("at") / BLOCK) + 1).cast("long").alias("n"))
    listed = ranked.groupBy("tree", block.alias("pos")).agg(F.sort_array(F.collect_list(F.struct("at", "leaf")))["leaf"].alias("nodes"))
    node = F.col("nodes")
    rows = listed.join(sized, "tree")
    whole = F.col("n") == 1
    for _ in range(DEPTH):  # each level is a column of its own rows, not an expression in the next
        rows = rows.withColumn("nodes", let(F.col("nodes"), lambda x: F.when(whole & (F.size(x) == 1), x).otherwise(_up(x))))
    return rows.select("tree", "pos", "n", F.get(node, 0).alias("node"))


def climb(nodes: DataFrame, name: str) -> tuple[DataFrame, list[DataFrame]]:
    """(tree, node) at the top of each tree, and per level its runs: tree, run, n, members."""
    most = nodes.agg(F.max("n")).first()[0] or 1
    tops, levels = nodes.filter("n = 1").select("tree", "node"), []
    nodes = nodes.filter("n > 1")
    while most > 1:
        runs = nodes.groupBy("tree", F.floor(F.col("pos") / FAN).cast("long").alias("run"), "n").agg(
            F.sort_array(F.collect_list(F.struct("pos", "node")))["node"].alias("members"))
        runs, _ = stage(runs, name)
        levels.append(runs)
        nodes = runs.select("tree", F.col("run").alias("pos"), F.ceil(F.col("n") / FAN).cast("long").alias("n"),
                            F.sha2(F.array_join("members", ""), 256).alias("node"))
        tops = tops.unionByName(nodes.filter("n = 1").select("tree", "node"))
        nodes = nodes.filter("n > 1")
        most = -(-most // FAN)
    return tops, levels


def descend(levels: list[DataFrame], tops: DataFrame, lone: DataFrame) -> DataFrame:
    """(tree, pos, path) of the nodes that ``climb`` began with.

    ``path`` is a list of siblings to the left and right, from below to above. ``tops`` has
    the path above each tree, ``lone`` the trees of one node.
    """
    path = lone.join(tops, "tree").select("tree", F.lit(0).cast("long").alias("pos"), "path")
    above = None
    for runs in reversed(levels):
        ended = runs.filter(F.col("n") <= FAN).select("tree").join(tops, "tree").select("tree", F.lit(0).cast("long").alias("run"), "path")
        above = ended if above is None else ended.unionByName(above.select("tree", F.col("pos").alias("run"), "path"))
        each = runs.join(above, ["tree", "run"]).select("tree", "run", "members", "path", F.posexplode("members").alias("i", "node"))
        own = F.struct(F.array_join(F.slice("members", 1, F.col("i")), "").alias("left"),
                       F.array_join(F.slice("members", F.col("i") + 2, FAN), "").alias("right"))
        above = each.select("tree", (F.col("run") * FAN + F.col("i")).alias("pos"), F.concat(F.array(own), "path").alias("path"))
        above, _ = stage(above, "paths")
    return path if above is None else path.unionByName(above)


def _hash(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def _fold(node: str, path: list) -> str:
    for left, right in path:
        node = _hash(left + node + right)
    return node


def _finish(kind: str):
    def finish(block: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("at", kind="stable")
        whole, subroot, root = bool(outer["n"].iloc[0] == 1), outer["subroot"].iloc[0], outer["root"].iloc[0]
        above = [(p["left"], p["right"]) for p in outer["path"].iloc[0]]
        nodes, sides = block["leaf"].tolist(), []  # sides: per level the pair of siblings of each node
        while len(sides) < DEPTH and not (whole and len(nodes) == 1):
            runs = [nodes[a:a + FAN] for a in range(0, len(nodes), FAN)]
            sides.append([("".join(r[:i]), "".join(r[i + 1:])) for r in runs for i in range(len(r))])
            nodes = [_hash("".join(r)) for r in runs]
        if nodes != [outer["node"].iloc[0]]:
            raise ValueError("a superblock's own reduction differs from the tree's node")
        proofs, folded = [], []
        for i, now in enumerate(block["now"]):
            path = [level[i // FAN ** k] for k, level in enumerate(sides)] + above
            proofs.append(_hash("".join(a + b for a, b in path)))
            folded.append(_fold(now, path))
        out = pd.DataFrame({"doc_id": block["doc_id"].array, "leaf": block["leaf"].array, "subroot": subroot, "root": root,
                            "proof_sha256": proofs, "folded_root": folded, "verified": [f == root for f in folded]})
        return out.astype({"doc_id": "Int64"}) if kind in ("bigint", "int") else out

    return finish


def manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """Per document: doc_id, leaf, subroot, root, proof_sha256, folded_root, verified.

    ``tampered`` is the text as it is found when the proof is checked.
    """
    ranked = placed(stage(leaves(docs, tampered), "leaves")[0], "tree", ["doc_id", "leaf"])
    nodes, _ = stage(blocks(ranked), "blocks")
    subroots, levels = climb(nodes, "runs")
    subroots, _ = stage(subroots, "subroots")
    sources = placed(subroots.select("tree", F.lit("").alias("all")), "all", ["tree"]).select(F.col("tree").alias("of"), "at")
    tops = subroots.join(sources, F.col("tree") == F.col("of")).select(
        F.col("tree").alias("of"), F.lit("").alias("tree"), F.col("at").alias("pos"), "node", F.lit(subroots.count()).cast("long").alias("n"))
    tops, _ = stage(tops, "tops")
    roots, upper = climb(tops, "upper")
    top = roots.first()
    nothing = F.array().cast("array<struct<left:string,right:string>>")
    outer = descend(upper, roots.select("tree", nothing.alias("path")), tops.filter("n = 1").select("tree"))
    facts = tops.join(outer.select("pos", "path"), "pos").select(
        F.col("of").alias("tree"), F.col("node").alias("subroot"), "path", F.lit(top and top["node"]).cast("string").alias("root"))
    facts, _ = stage(facts, "facts")
    paths = descend(levels, facts.select("tree", "path"), nodes.filter("n = 1").select("tree"))
    needed = nodes.join(paths, ["tree", "pos"]).join(facts.drop("path"), "tree")
    own = ranked.withColumn("pos", F.floor(F.col("at") / BLOCK).cast("long"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    return own.groupBy("tree", "pos").cogroup(needed.groupBy("tree", "pos")).applyInPandas(
        _finish(kind), f"doc_id {kind}, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
