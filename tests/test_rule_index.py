"""Indexed bundles against the CASE form, plain matching, and enumeration of features."""

import itertools
import random

import pytest
from pyspark.sql import functions as F
from tables import SMALL

from guardlake.operators import policy, rule_index
from guardlake.plans import q_decide
from guardlake.sources.bundle import Bundle, shipped

LABELS = [f"label{i}" for i in range(300)]
STATES = ("normal", "elevated", "restricted", "blocked")


def bundle_of(conditions, enabled=lambda i: True):
    decision = shipped().default
    return Bundle("t", tuple({"name": f"r{i}", "enabled": enabled(i), "condition": c, "decision": {**decision, "action": ("deny", "allow")[i % 2]}}
                             for i, c in enumerate(conditions)), decision)


def holds(key, v, row):
    how, name = rule_index.KINDS.get(key, (None, None))
    x = row[name] if name else None
    return {rule_index.HAS: lambda: v in (x or ()), rule_index.LACKS: lambda: v not in (x or ()), rule_index.IS: lambda: x is not None and x == v,
            rule_index.REACHES: lambda: x is not None and x >= v, None: lambda: False}[how]()


def plain(bundle, row):
    return [i for i, r in enumerate(bundle.rules) if r["enabled"] and all(holds(k, v, row) for k, v in r["condition"].items())]


SCHEMA = ("id int, permissions array<string>, input_labels array<string>, dlp_labels array<string>, input_score int, dlp_score int, "
          "confidence double, risk_state string, label string, step_up boolean")


def rows_of(n):
    rng = random.Random(1)
    some = lambda: rng.choice((None, [], rng.sample(LABELS, 5), rng.sample(LABELS, 40)))
    return [(i, rng.choice((None, [], ["llm:chat"], ["llm:chat", "x"])), some(), some(), rng.choice((None, rng.randrange(100))), rng.randrange(100),
             rng.choice((None, 0.5, 0.9, 0.95)), rng.choice((None, *STATES)), rng.choice((None, *LABELS[:9])), rng.choice((None, True, False))) for i in range(n)]


def some_condition(rng):
    kind = rng.choice([*rule_index.KINDS, "of_no_kind"])
    return kind, {"missing_permission": lambda: rng.choice(("llm:chat", "x", "y")), "input_scan_score_gte": lambda: rng.randrange(100), "dlp_score_gte": lambda: rng.randrange(100),
                  "classification_confidence_gte": lambda: rng.choice((0.4, 0.9, 0.92)), "session_risk_state": lambda: rng.choice(STATES),
                  "classification_label": lambda: rng.choice(LABELS[:9]), "step_up_authenticated": lambda: rng.random() < .5}.get(kind, lambda: rng.choice(LABELS))()


def test_shipped_bundles_decide_alike(spark):
    rows = q_decide.classified(spark, SMALL)
    for bundle in (shipped(), shipped("candidate")):
        both = rows.select(policy.decided_ord(bundle).alias("a"), rule_index.decided_ord(bundle).alias("b"))
        assert both.filter("NOT a <=> b").count() == 0


def test_five_thousand_rules(spark):
    rng = random.Random(2)
    bundle = bundle_of([dict(some_condition(rng) for _ in range(rng.randrange(1, 4))) for _ in range(5000)], lambda i: i % 17 > 0)
    rows = rows_of(120)
    got = spark.createDataFrame(rows, SCHEMA).select("id", rule_index.matches(bundle).alias("m")).collect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    want = {r[0]: plain(bundle, dict(zip(names, r))) for r in rows}
    assert {r["id"]: r["m"] for r in got} == want
    assert sum(map(len, want.values())) > 1000


def test_the_table_is_a_constant_of_the_plan(spark):
    plan = spark.createDataFrame(rows_of(3), SCHEMA).select(rule_index.decided_ord(shipped()))._jdf.queryExecution().optimizedPlan().toString()
    assert "cast(map(" not in plan and "cast(array(" not in plan  # a folded literal has lost its cast


@pytest.mark.parametrize("conditions", [[], [{}], [{}, {"dlp_score_gte": 5}], [{"of_no_kind": 1}, {"dlp_score_gte": 5}]])
def test_odd_bundles(spark, conditions):
    bundle, rows = bundle_of(conditions), rows_of(20)
    got = spark.createDataFrame(rows, SCHEMA).select("id", rule_index.matches(bundle).alias("m")).collect()
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    assert {r["id"]: r["m"] for r in got} == {r[0]: plain(bundle, dict(zip(names, r))) for r in rows}


def test_implications_against_all_features(spark):
    pool = [("input_scan_has_label", "a"), ("input_scan_has_label", "b"), ("dlp_score_gte", 10), ("dlp_score_gte", 20), ("session_risk_state", "normal"), ("step_up_authenticated", True)]
    rng = random.Random(3)
    bundle = bundle_of([dict(rng.sample(pool, rng.randrange(0, 4))) for _ in range(40)], lambda i: i % 9 > 0)
    features = [dict(permissions=[], input_labels=list(labels), dlp_labels=[], input_score=0, dlp_score=score, confidence=0.0, risk_state=state, label="", step_up=step)
                for labels in ((), ("a",), ("b",), ("a", "b")) for score, state, step in itertools.product((0, 10, 20), ("normal", "other"), (True, False))]
    matched = [set(plain(bundle, f)) for f in features]
    on = [i for i, r in enumerate(bundle.rules) if r["enabled"]]
    within = {(a, b) for a in on for b in on if a != b and all(b in m for m in matched if a in m)}  # a matches only where b does
    want = {(i, j, "never_decides" if (j, i) in within else "exception") for i in on for j in on if i < j and {(i, j), (j, i)} & within}
    got = {(r["earlier"], r["later"], r["relation"]) for r in rule_index.implications(spark, bundle).collect()}
    assert got == want
    dead = {j for i, j, relation in want if relation == "never_decides"}
    assert dead and not any(min(m) in dead for m in matched if m)


def test_backtest_by_index(spark):
    rows = q_decide.classified(spark, SMALL)
    key = lambda df: sorted(map(tuple, df.select("old_action", "new_action", "requests").collect()))
    assert key(rule_index.transitions(rows, shipped(), shipped("candidate"))) == key(policy.transitions(rows, shipped(), shipped("candidate")))
    assert F is not None
