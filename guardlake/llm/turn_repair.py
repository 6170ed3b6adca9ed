"""Repair of damaged conversations by the cheapest edits, by dynamic programming over grammar-compressed rows.

Every row of a conversation becomes one symbol: its role's initial (lower case; upper case
if its text is truncated), or ``D`` where it must go (blank, or role and text seen before).
The rows kept, with insertions, must read ``(s?(ua)+)?`` by initials. An automaton of four
states (nothing yet, system only, after a user, after an assistant) accepts that, so a run
of symbols is a 4 x 4 matrix over (min, +): the least cost from state to state, and the
edits that give it, the ASCII-least among equals. (Two edit texts of equal cost for the
same rows never begin one another, so the order of parts decides the order of the whole.)

1. Rows take their place in their conversation (``ranking.placed``), and repeats are found
   as an aggregate per (conversation, role, text): no conversation has to fit into a task.
2. A conversation is cut into blocks of ``BLOCK`` symbols. A Re-Pair grammar is learned from
   the distinct blocks with their frequencies: in each round the commonest pairs of
   neighbours that share no symbol become new symbols (``grammar``).
3. Each rule has one matrix, the product of its two parts, with its edits as a rope (a tree
   of shared parts); all conversations use the same ones. A block is the product of few
   symbols, and long conversations are products of blocks, level by level.
4. The edits of a conversation and its rows meet in one sorted stream that hashes the
   repaired rows one after the other and holds one row at a time. (A SHA-256 is sequential,
   so one conversation's text passes one task; no more than its edits is held.)

Defined results: a null role or text is a single space, and so are a null conv_id and turn
where the row's damage is drawn; rows with a null conv_id are one conversation; a null turn
comes first; rows alike in turn stand by role, then by the SHA-256 of their text; rows that
repeat as a whole are duplicates; an empty text is blank, a very long one is only read for
its hash and its last character; a conversation without rows has zeros, no edits and the
hash of an empty text; an empty table gives no rows; further columns are never read.
"""

from __future__ import annotations

import functools
import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.llm.ranking import placed
from guardlake.llm.shared import drop, stage

BLOCK, FAN = 1024, 32
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: States, and where an output role leads from each.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {"s": {NOTHING: SYSTEM}, "u": {NOTHING: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
#: Non-terminal symbols of the grammar start here (a range for private use).
FIRST_RULE = 0xE000

# --- edits: a rope is a text or a pair of ropes; a matrix maps (from, to) to (cost, rope) ---


def flat(rope) -> str:
    parts, todo = [], [rope]
    while todo:
        top = todo.pop()
        if isinstance(top, str):
            parts.append(top)
        else:
            todo += [top[1], top[0]]
    return "".join(parts)


def better(a, b):
    """The cheaper of two entries, at equal cost the one with the ASCII-least edits."""
    if b is None or a is not None and a[0] < b[0]:
        return a
    if a is None or b[0] < a[0]:
        return b
    return a if flat(a[1]) <= flat(b[1]) else b


def times(left: dict, right: dict) -> dict:
    """The matrix of two runs of rows one after the other."""
    out: dict = {}
    for (i, k), (cost, rope) in left.items():
        for (k2, j), (more, rest) in right.items():
            if k2 == k:
                out[i, j] = better((cost + more, (rope, rest)), out.get((i, j)))
    return out


def _insertions() -> dict:
    """Up to two inserted rows; more would only return to a state."""
    one = {(i, i): (0, "") for i in range(4)}
    step = {(i, j): (INSERT, "I") for role in "ua" for i, j in NEXT[role].items()}
    for _ in range(2):
        reached = times(one, step)
        one = {k: better(one.get(k), reached.get(k)) for k in {*one, *reached}}
    return one


INSERTED = _insertions()


@functools.cache
def terminal(symbol: str) -> dict:
    """The matrix of one row, with what may be inserted before it."""
    edits = {(i, i): (DELETE, "D") for i in range(4)}
    if symbol != "D":
        extra, own = (TRUNCATED if symbol.isupper() else 0), symbol.lower()
        for role in "sua":
            for i, j in NEXT[role].items():
                if role == own:
                    edits[i, j] = better((KEEP + extra, "K"), edits.get((i, j)))
                elif role != "s":
                    edits[i, j] = better((REROLE + extra, "R"), edits.get((i, j)))
    return times(INSERTED, edits)


def matrices(rules: list[tuple[str, str]]) -> dict[str, dict]:
    """Rule symbol: matrix, bottom up; a rule's parts are terminals or earlier rules."""
    done: dict[str, dict] = {}
    for symbol, (left, right) in rules:
        done[symbol] = times(*[done[c] if c in done else terminal(c) for c in (left, right)])
    return done


def ended(vector: dict) -> tuple[int, str]:
    """The cheapest way to accept, with what may be inserted at the end."""
    last = times(vector, INSERTED)
    best = better(last.get((NOTHING, NOTHING)), last.get((NOTHING, ASSISTANT)))
    return best[0], flat(best[1])


# --- rows ---


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage: key, conv_id, turn, role, text, copy (0, and 1 for a repeated row)."""
    def plain(c: str) -> Column:
        return F.coalesce(rows[c].cast("string"), F.lit(" "))

    lot = F.crc32(F.concat(plain("conv_id"), F.lit(":"), plain("turn")).cast("binary")) % 20
    read = rows.select("conv_id", "turn", plain("role").alias("role"), plain("text").alias("text"), lot.alias("lot")).filter("lot <> 0")
    text = F.when(F.col("lot") == 1, "").when(F.col("lot") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("lot") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return read.select(key_of(F.col("conv_id")).alias("key"), "conv_id", "turn", F.when(F.col("lot") == 4, "user").otherwise(F.col("role")).alias("role"),
                       text.alias("text"), F.explode(copies).alias("copy"))


def key_of(conv: Column) -> Column:
    return F.coalesce(F.concat(F.lit("c"), conv.cast("string")), F.lit(""))


def symbols(rows: DataFrame) -> DataFrame:
    """Per row: key, at, initial, blank, duplicate, truncated, symbol. A written table, without texts."""
    text = F.col("text")
    initial = F.substring("role", 1, 1)
    narrow = rows.select(
        "key", "turn", "role", F.sha2(text, 256).alias("hash"), "copy", F.when(initial.isin("s", "u", "a"), initial).otherwise("x").alias("initial"),
        (~text.rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~text.rlike(r"[.!?][\x20\x09-\x0D]*\z")).alias("open"))
    ranked = placed(narrow, "key", ["turn", "role", "hash", "copy"])
    first = ranked.groupBy("key", "role", "hash").agg(F.min("at").alias("at")).select("key", "at", F.lit(True).alias("first"))
    found = ranked.join(first, ["key", "at"], "left")
    again = ~F.col("blank") & F.col("first").isNull()
    cut = ~F.col("blank") & ~again & F.col("open")
    symbol = F.when(F.col("blank") | again, "D").when(cut, F.upper("initial")).otherwise(F.col("initial"))
    return stage(found.select("key", "at", "turn", "initial", "blank", again.alias("duplicate"), cut.alias("truncated"), symbol.alias("symbol")), "symbols")[0]


def in_blocks(rows: DataFrame) -> DataFrame:
    """Per block of a conversation: its symbols as a text, counts of faults and of unlawful neighbours, its first and last initial."""
    def text(name: str) -> Column:
        return F.array_join(F.sort_array(F.collect_list(F.struct("at", name)))[name], "")

    lists = rows.groupBy("key", F.floor(F.col("at") / BLOCK).cast("long").alias("block")).agg(
        text("symbol").alias("symbols"), text("initial").alias("initials"),
        *[F.count_if(c).alias(c) for c in ("blank", "duplicate", "truncated")])
    lawful = F.regexp_count("initials", F.lit("s(?=u)|u(?=a)|a(?=u)"))
    return stage(lists.select("key", "block", "symbols", "blank", "duplicate", "truncated",
                              (F.length("initials") - 1 - lawful).cast("long").alias("illegal"),
                              F.left("initials", F.lit(1)).alias("head"), F.right("initials", F.lit(1)).alias("tail")), "blocks")[0]


def rewritten(text: Column, rules: list[tuple[str, tuple[str, str]]]) -> Column:
    for symbol, (left, right) in rules:
        text = F.replace(text, F.lit(left + right), F.lit(symbol))
    return text


def grammar(blocks: DataFrame, rounds: int = 6, a_round: int = 12) -> list[tuple[str, tuple[str, str]]]:
    """Rules (symbol, (left, right)) in order, learned from all blocks by rounds of Re-Pair. At most rounds * a_round rules."""
    distinct, path = stage(blocks.groupBy("symbols").agg(F.count(F.lit(1)).alias("n")), "sequences")
    rules: list = []
    for _ in range(rounds):
        text = distinct.select("n", rewritten(F.col("symbols"), rules).alias("text")).filter("length(text) > 1")
        pairs = text.select("n", F.explode(F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring("text", i, F.lit(2)))).alias("pair"))
        common = pairs.groupBy("pair").agg(F.sum("n").alias("n")).filter("n > 1").orderBy(F.desc("n"), "pair").limit(a_round * 8).collect()
        used: set = set()
        for row in common:
            left, right = row["pair"]
            if not {left, right} & used and len(used) < 2 * a_round:
                used |= {left, right}
                rules.append((chr(FIRST_RULE + len(rules)), (left, right)))
        if not used:
            break
    drop(blocks.sparkSession, path)
    return rules


ENTRIES = "entries array<struct<from:int,to:int,cost:long,edits:string>>"


def _unpacked(entries) -> dict:
    return {(e["from"], e["to"]): (e["cost"], e["edits"]) for e in entries}


def _packed(matrix: dict) -> list[dict]:
    return [{"from": i, "to": j, "cost": c, "edits": flat(r)} for (i, j), (c, r) in sorted(matrix.items())]


def _solver(rules: list):
    """Blocks to matrices; the first block of a conversation starts in the state of nothing."""
    known = matrices(rules)

    kind = pa.list_(pa.struct([("from", pa.int32()), ("to", pa.int32()), ("cost", pa.int64()), ("edits", pa.string())]))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        @functools.lru_cache(8192)
        def solved(text: str, first: bool) -> list[dict]:
            value = {(i, i): (0, "") for i in range(1 if first else 4)}
            for symbol in text:
                value = times(value, known[symbol] if symbol in known else terminal(symbol))
            return _packed(value)

        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts, blocks = part.column("text").to_pylist(), part.column("block").to_pylist()
                entries = pa.array([solved(t, b == 0) for t, b in zip(texts, blocks)], kind)
                yield pa.RecordBatch.from_arrays([part.column("key"), part.column("block"), entries], names=["key", "block", "entries"])

    return solve


def _merged(rows: pd.DataFrame) -> pd.DataFrame:
    """The blocks of one run to one matrix."""
    rows = rows.sort_values("block")
    value = functools.reduce(times, [_unpacked(e) for e in rows["entries"]])
    return pd.DataFrame({"key": [rows["key"].iloc[0]], "block": [rows["block"].iloc[0] // FAN], "entries": [_packed(value)]})


def _finished(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ends = [ended(_unpacked(e)) for e in batch.column("entries").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([c for c, _ in ends], pa.int64()), pa.array([t for _, t in ends], pa.string())],
                                         names=["key", "cost", "audit"])


def solutions(blocks: DataFrame) -> DataFrame:
    """Per conversation with rows: key, cost, audit. A written table."""
    rules = grammar(blocks)
    texts = blocks.select("key", "block", rewritten(F.col("symbols"), rules).alias("text"))
    parts, _ = stage(texts.mapInArrow(_solver(rules), f"key string, block long, {ENTRIES}"), "parts")
    long = parts.filter("block > 0").select("key").distinct()
    whole, parts = parts.join(long, "key", "left_anti"), parts.join(long, "key", "left_semi")
    most = blocks.agg(F.max("block")).first()[0] or 0
    while most > 0:
        runs = parts.groupBy("key", F.floor(F.col("block") / FAN).alias("run"))
        parts, _ = stage(runs.applyInPandas(_merged, f"key string, block long, {ENTRIES}"), "parts")
        most //= FAN
    return stage(whole.unionByName(parts).select("key", "entries").mapInArrow(_finished, "key string, cost long, audit string"), "edits")[0]


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows, each conversation's edits before its rows, to the hash of its repaired rows."""
    done: list = []
    key = edits = sha = None
    at, role, lines = 0, "", 0

    def line(who: str, text: str) -> None:
        nonlocal lines
        sha.update(("\n" if lines else "").encode() + who.encode() + b":" + text.encode())
        lines += 1

    def turned(own: str | None) -> str:
        """The role of the next line: its own, or the only one that may be given here."""
        return own if own is not None else "assistant" if role == "u" else "user"

    def inserted() -> None:
        nonlocal at, role
        while at < len(edits) and edits[at] == "I":
            who = turned(None)
            line(who, "")
            at, role = at + 1, who[0]

    def close() -> None:
        if key is not None:
            inserted()
            done.append((key, sha.hexdigest()))

    def batch_of() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([h for _, h in done], pa.string())], names=["key", "repaired_sha256"])
        done.clear()
        return out

    for batch in batches:
        columns = [batch.column(c) for c in ("key", "audit", "role", "text")]
        for i in range(batch.num_rows):
            this, audit, who, text = (c[i].as_py() for c in columns)
            if audit is not None:
                close()
                key, edits, sha, at, role, lines = this, audit, hashlib.sha256(), 0, "", 0
                continue
            inserted()
            edit = edits[at]
            at += 1
            if edit != "D":
                line(who := turned(who if edit == "K" else None), text)
                role = who[0]
        if len(done) >= 1000:
            yield batch_of()
    close()
    yield batch_of()


def hashes(rows: DataFrame, edits: DataFrame) -> DataFrame:
    """Per conversation with rows: key, repaired_sha256."""
    order = ["turn", "role", "hash", "copy"]
    own = rows.select("key", F.lit(None).cast("string").alias("audit"), "turn", "role", F.sha2("text", 256).alias("hash"), "copy", "text")
    heads = edits.select("key", "audit", *[F.lit(None).cast(own.schema[c].dataType).alias(c) for c in (*order, "text")])
    both = own.unionByName(heads).withColumn("row", F.col("audit").isNull())
    stream = both.repartition("key").sortWithinPartitions("key", "row", *[F.col(c).asc_nulls_first() for c in order])
    return stream.select("key", "audit", "role", "text").mapInArrow(_hashed, "key string, repaired_sha256 string")


COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def report(rows: DataFrame) -> DataFrame:
    """Per conv_id of ``rows``, damaged by the contract and repaired: conv_id, the counts, audit, repaired_sha256."""
    hurt = damaged(rows.select("conv_id", "turn", "role", "text"))
    marked = symbols(hurt)
    blocks = in_blocks(marked)
    turns = marked.select("key", "turn").distinct().groupBy("key").agg(
        F.coalesce(F.max("turn") - F.min("turn") + 1 - F.count("turn"), F.lit(0)).cast("long").alias("gaps"))
    after = blocks.select("key", (F.col("block") - 1).alias("block"), F.col("head").alias("then"))
    joints = blocks.select("key", "block", "tail").join(after, ["key", "block"]).select(
        "key", *[F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")],
        F.when(F.concat("tail", "then").isin("su", "ua", "au"), 0).otherwise(1).cast("long").alias("illegal"))
    counts = blocks.select(*joints.columns).unionByName(joints).groupBy("key").agg(
        *[F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal")])
    edits = solutions(blocks)
    all_ids = rows.select("conv_id").distinct().withColumn("key", key_of(F.col("conv_id")))
    found = all_ids.join(turns, "key", "left").join(counts, "key", "left").join(edits, "key", "left").join(hashes(hurt, edits), "key", "left")
    return found.select("conv_id", *[F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in COUNTS], F.coalesce("audit", F.lit("")).alias("audit"),
                        F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
