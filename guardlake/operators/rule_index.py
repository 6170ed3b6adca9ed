"""Bundles of thousands of rules: conditions as bits, rules as required bits in a table indexed by their rarest bit.

One CASE per bundle (``policy.decided_ord``) is the fastest form for some dozen rules, but its
code grows with the rules. Here the size of the expression depends on the kinds of
conditions only. Conditions on one feature are looked up together: the labels a row has, the
permissions it lacks, its value, the thresholds it reaches. That gives the numbers of the
conditions that hold, and a bit mask of them. A rule is a mask too. It is filed under that
one of its conditions that the fewest rules have, so a row looks only at rules filed under
conditions that hold for it, and a rule matches if the row's mask covers its own. The table
is a constant of the plan; a bundle is a file, so its size is bounded by its kind.

Kinds that a user has added to ``policy.CONDITIONS`` take an expression of their own each.
A rule without conditions always matches; unknown kinds never hold; nulls hold nothing
(a null list of permissions lacks them all). An empty bundle decides nothing.
"""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake.functions.rows import let
from guardlake.operators import policy as P
from guardlake.sources.bundle import Bundle

#: How the built-in kinds of conditions read their feature.
HAS, LACKS, IS, REACHES = range(4)
KINDS = {
    "missing_permission": (LACKS, "permissions"), "input_scan_has_label": (HAS, "input_labels"), "dlp_has_label": (HAS, "dlp_labels"),
    "input_scan_score_gte": (REACHES, "input_score"), "dlp_score_gte": (REACHES, "dlp_score"), "classification_confidence_gte": (REACHES, "confidence"),
    "session_risk_state": (IS, "risk_state"), "classification_label": (IS, "label"), "step_up_authenticated": (IS, "step_up"),
}
WORD = 62


def conditions(bundle: Bundle) -> list[tuple[str, object]]:
    """The distinct conditions of enabled rules; their place is their number."""
    return list(dict.fromkeys((k, v) for r in bundle.rules if r["enabled"] for k, v in r["condition"].items()))


def _text(value) -> str:
    return str(value).lower() if isinstance(value, bool) else str(value)


def _constant(value, kind: str) -> Column:
    """A list, a dict with text keys or a number as a constant that the optimizer folds into one literal of type ``kind``."""
    def sql(v) -> str:
        if isinstance(v, dict) and "o" not in v and "v" not in v:
            return "map(" + ", ".join(f"{sql(k)}, {sql(x)}" for k, x in v.items()) + ")"
        if isinstance(v, dict):
            return "named_struct(" + ", ".join(f"'{k}', {sql(x)}" for k, x in v.items()) + ")"
        if isinstance(v, list):
            return "array(" + ", ".join(map(sql, v)) + ")"
        if isinstance(v, str):
            return "'" + v.replace("\\", "\\\\").replace("'", "\\'") + "'"
        return f"{v!r}D" if isinstance(v, float) else f"{v}L"

    return F.expr(f"cast({sql(value)} AS {kind})")


def _found(kind: str, own: list[tuple[object, int]]) -> Column:
    """Numbers of those conditions of a built-in kind that hold. ``own``: value and number of each."""
    how, name = KINDS[kind]
    feature = F.col(name)
    if how == REACHES:
        rows = [{"v": float(v if kind.endswith("confidence_gte") else int(v)), "i": i} for v, i in own]
        table = _constant(rows, "array<struct<v:double,i:int>>")
        return F.transform(F.filter(table, lambda s: F.coalesce(feature >= s["v"], F.lit(False))), lambda s: s["i"])
    number = _constant({_text(v): i for v, i in own}, "map<string,int>")
    have = F.coalesce(feature, F.array().cast("array<string>")) if how in (HAS, LACKS) else F.array(feature.cast("string"))
    wanted = F.array_except(F.map_keys(number), have) if how == LACKS else F.array_intersect(F.map_keys(number), have)
    return F.transform(wanted, lambda x: number[x])


def holding(numbered: list[tuple[str, object]]) -> Column:
    """Numbers of the conditions that hold for a row."""
    parts, none = [], F.array().cast("array<int>")
    kinds = dict.fromkeys(k for k, _ in numbered)
    for kind in kinds:
        own = [(v, i) for i, (k, v) in enumerate(numbered) if k == kind]
        if kind not in KINDS:
            parts.append(F.array_compact(F.array(*[F.when(P.condition(kind, v), F.lit(i)) for v, i in own])))
            continue
        parts.append(F.coalesce(_found(kind, own), none))
    return F.concat(*parts) if parts else none


def _mask(ids, words: int):
    if isinstance(ids, Column):
        return F.transform(F.sequence(F.lit(0), F.lit(words - 1)), lambda w: F.aggregate(
            F.filter(ids, lambda i: F.floor(i / WORD) == w), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i % WORD))))
    return [sum(1 << (i % WORD) for i in ids if i // WORD == w) for w in range(words)]


def matches(bundle: Bundle) -> Column:
    """Order numbers of all enabled rules that match, ascending."""
    numbered = conditions(bundle)
    number = {c: i for i, c in enumerate(numbered)}
    rules = [(i, sorted(number[c] for c in r["condition"].items())) for i, r in enumerate(bundle.rules) if r["enabled"]]
    used = Counter(c for _, need in rules for c in need)
    words = max(1, -(-len(numbered) // WORD))
    filed: list[list[dict]] = [[] for _ in numbered]
    for i, need in rules:
        if need:
            filed[min(need, key=lambda c: (used[c], c))].append({"o": i, "need": _mask(need, words)})
    table = _constant(filed, "array<array<struct<o:int,need:array<bigint>>>>")
    always = _constant([i for i, need in rules if not need], "array<int>")

    def of(ids: Column) -> Column:
        def fitting(mask: Column) -> Column:
            def fits(rule: Column) -> Column:
                return F.forall(F.zip_with(rule["need"], mask, lambda n, m: n.bitwiseAND(m) == n), lambda x: x)
            return F.flatten(F.transform(ids, lambda c: F.transform(F.filter(F.get(table, c), fits), lambda r: r["o"])))
        return let(_mask(ids, words), fitting)

    return F.array_sort(F.concat(always, let(holding(numbered), of)))


def decided_ord(bundle: Bundle) -> Column:
    """Order number of the first enabled rule that matches; null for the default."""
    return F.get(matches(bundle), 0)


def transitions(df: DataFrame, old: Bundle, new: Bundle) -> DataFrame:
    """Requests by the action of both bundles. Actions come from tables of the bundles, by rule."""
    both = df.select(F.coalesce(decided_ord(old), F.lit(-1)).alias("old_ord"), F.coalesce(decided_ord(new), F.lit(-1)).alias("new_ord"))
    few = both.groupBy("old_ord", "new_ord").agg(F.count(F.lit(1)).alias("requests"))
    for side, bundle in (("old", old), ("new", new)):
        rows = [(-1, bundle.default["action"]), *[(i, r["decision"]["action"]) for i, r in enumerate(bundle.rules)]]
        few = few.join(df.sparkSession.createDataFrame(rows, f"{side}_ord int, {side}_action string"), f"{side}_ord")
    return few.groupBy("old_action", "new_action").agg(F.sum("requests").alias("requests"))


def implications(spark: SparkSession, bundle: Bundle) -> DataFrame:
    """Pairs of enabled rules of which one matches whenever the other does: earlier, later, relation, same_decision.

    ``never_decides``: the later rule implies the earlier, so it can never be the first to match.
    ``exception``: the earlier implies the later (and not the reverse), so it decides first for a part of the
    later's rows; changing their places would silence it. Threshold conditions imply all lower ones of their
    kind, other conditions only themselves. A rule implies another if its conditions imply all of the other's,
    counted by an equality join on conditions.
    """
    numbered = conditions(bundle)
    number = {c: i for i, c in enumerate(numbered)}
    own = [(i, number[c], len(r["condition"])) for i, r in enumerate(bundle.rules) if r["enabled"] for c in r["condition"].items()]
    lower = [(number[k, v], number[k, w]) for k, v in numbered for k2, w in numbered
             if k == k2 and (v == w or KINDS.get(k, (None,))[0] == REACHES and float(w) <= float(v))]
    has = spark.createDataFrame(own, "rule int, cond int, size int")
    implied = has.select(F.col("rule").alias("by"), F.col("cond").alias("own")).join(
        spark.createDataFrame(lower, "own int, cond int"), "own").select("by", "cond").distinct()
    pairs = has.join(implied, "cond").filter("rule <> by").groupBy("by", "rule").agg(F.count(F.lit(1)).alias("n"), F.max("size").alias("size")).filter("n = size")
    pairs = pairs.select(F.col("by").alias("narrow"), F.col("rule").alias("wide"))
    free = [(j, i) for i, r in enumerate(bundle.rules) if r["enabled"] and not r["condition"] for j, s in enumerate(bundle.rules) if s["enabled"] and j != i]
    pairs = pairs.unionByName(spark.createDataFrame(free, "narrow int, wide int")).distinct()
    decision = spark.createDataFrame([(i, json.dumps(r["decision"], sort_keys=True)) for i, r in enumerate(bundle.rules)], "rule int, decision string")
    placed = pairs.select(F.least("narrow", "wide").alias("earlier"), F.greatest("narrow", "wide").alias("later"), (F.col("narrow") > F.col("wide")).alias("dead"))
    named = placed.groupBy("earlier", "later").agg(F.when(F.bool_or("dead"), "never_decides").otherwise("exception").alias("relation"))
    first, second = (decision.select(F.col("rule").alias(n), F.col("decision").alias(f"{n}_decision")) for n in ("earlier", "later"))
    return named.join(first, "earlier").join(second, "later").select(
        "earlier", "later", "relation", (F.col("earlier_decision") == F.col("later_decision")).alias("same_decision"))
