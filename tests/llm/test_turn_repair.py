"""Conversation repair against a plain dynamic program, and that against a search of all edits."""

import random

import brute
from compare import compare, views

from guardlake.llm import queries, sql, turn_repair

COLUMNS = ("conv_id", *turn_repair.COUNTS, "audit", "repaired_sha256")
SCHEMA = "conv_id long, turn long, role string, text string"


def rows_of(df):
    return sorted(map(tuple, df.select(*COLUMNS).collect()), key=repr)


def some_rows(seed, n):
    rng = random.Random(seed)
    roles = ("user", "assistant", "system", "tool", "", "User")
    return [(rng.choice(roles[:rng.choice((2, 3, 6))]), rng.choice(("a.", "b!", "c", " ", "d? ", "e", "f.\n"))) for _ in range(n)]


def symbol(role, fault):
    initial = role[:1] if role[:1] in ("s", "u", "a") else "x"
    return "D" if fault in ("blank", "duplicate") else initial.upper() if fault else initial


def test_the_plain_program_finds_the_best_of_all_edits():
    for seed in range(150):
        rows = some_rows(seed, seed % 5)
        best = min(brute.all_repairs(rows), key=lambda x: x[:2])
        assert brute.repaired(rows) == best, rows


def test_matrices_of_rules_equal_single_rows():
    for seed in range(200):
        rows = some_rows(seed, 1 + seed % 23)
        text = "".join(symbol(role, fault) for (role, _), fault in zip(rows, brute.faults(rows)))
        rules = [(chr(turn_repair.FIRST_RULE + i), pair) for i, pair in enumerate({(a, b) for a, b in zip(text, text[1:])})]
        known, value, left = turn_repair.matrices(rules), {(0, 0): (0, "")}, text
        for rule, pair in rules:
            left = left.replace("".join(pair), rule)
        for c in left:
            value = turn_repair.times(value, known[c] if c in known else turn_repair.terminal(c))
        assert turn_repair.ended(value) == brute.repaired(rows)[:2]


def test_odd_rows(spark):
    rng = random.Random(3)
    rows = [(c, t, *some_rows(100 * c + t, 1)[0]) for c in range(60) for t in range(rng.randrange(1, 12))]
    rows += [(None, 1, "user", "a."), (None, None, None, "b."), (None, 2, "user", None), (7, None, "user", "c"), (7, None, "assistant", "d."),
             (7, 3, "user", "x" * 300_000), (99, 0, None, None), rows[5], rows[5], (1000, 5, "user", "")]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'own' AS key", "'own' AS symbol", "'own' AS audit")
    assert rows_of(turn_repair.report(df)) == brute.turn_repair(rows)
    assert turn_repair.report(df.filter("false")).count() == 0


def test_one_conversation_of_many_blocks(spark):
    rng = random.Random(5)
    rows = [(1, t, rng.choice(("user", "assistant", "assistant", "system")), f"text {rng.randrange(4000)}{rng.choice('.!  ')}") for t in range(5000)]
    rows += [(2, t, ("user", "assistant")[t % 2], f"{t}.") for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA)
    block = turn_repair.BLOCK
    try:
        turn_repair.BLOCK = 16  # several levels of merging
        got = rows_of(turn_repair.report(df))
    finally:
        turn_repair.BLOCK = block
    assert got == brute.turn_repair(rows)


def test_grammar_shares_rules(spark):
    blocks = spark.createDataFrame([("ua" * 8,)] * 50 + [("sua",)] * 9, "symbols string")
    rules = turn_repair.grammar(blocks)
    assert rules[0][1] == ("u", "a")
    short = blocks.select(turn_repair.rewritten(blocks["symbols"], rules).alias("s")).distinct().collect()
    assert max(len(r["s"]) for r in short) <= 2


def test_repair_equals_sql(spark):
    for folder in ("/root/testdata/sf0.001", "/root/testdata/sf0.01"):
        assert compare(spark, views(folder), folder, queries.op12_turn_repair, sql.SQL["op12_turn_repair"])[0] == "ok"
