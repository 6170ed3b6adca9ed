"""Policy bundles as data: compiled to one CASE per bundle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions.cache import remember
from guardlake.functions.rows import posexploded
from guardlake.sources.bundle import Bundle, rule_table

_has = lambda col, value: F.array_contains(F.coalesce(F.col(col), F.array().cast("array<string>")), value)

# Predicate kinds; users may add entries: key -> (expected value -> Column).
CONDITIONS: dict[str, Callable[[object], Column]] = {
    "missing_permission": lambda v: ~_has("permissions", v),
    "input_scan_has_label": lambda v: _has("input_labels", v),
    "input_scan_score_gte": lambda v: F.col("input_score") >= int(v),
    "session_risk_state": lambda v: F.col("risk_state") == v,
    "step_up_authenticated": lambda v: F.col("step_up") == F.lit(v),
    "dlp_has_label": lambda v: _has("dlp_labels", v),
    "dlp_score_gte": lambda v: F.col("dlp_score") >= int(v),
    "classification_label": lambda v: F.col("label") == v,
    "classification_confidence_gte": lambda v: F.col("confidence") >= float(v),
}


def condition(key: str, expected) -> Column:
    """One predicate; unknown kinds and missing features are false."""
    builder = CONDITIONS.get(key)
    return F.coalesce(builder(expected), F.lit(False)) if builder else F.lit(False)


def rule_matches(rule: dict) -> Column:
    out = F.lit(True)
    for key, expected in rule["condition"].items():
        out = out & condition(key, expected)
    return out


@remember
def decided_ord(bundle: Bundle) -> Column:
    """Order number of the first enabled rule that matches; null for the default."""
    chain = None
    for i, rule in enumerate(bundle.rules):
        if rule["enabled"]:
            chain = (F.when if chain is None else chain.when)(rule_matches(rule), F.lit(i))
    return F.lit(None).cast("int") if chain is None else chain


def decide(df: DataFrame, bundle: Bundle) -> DataFrame:
    """First matching rule wins; the decision's fields come from the bundle's rule table,
    which is broadcast (a bundle is a file of at most some hundred rules)."""
    table = rule_table(df.sparkSession, bundle).select(
        "rule_ord", "rule_name", "action", "reason_codes", "disable_tools", "allow_retrieval",
        "max_context_sensitivity", "require_human_approval", "response_mode", "enforce_token_budget")
    ordered = df.withColumn("rule_ord", F.coalesce(decided_ord(bundle), F.lit(-1)))
    return ordered.join(F.broadcast(table), "rule_ord", "left")


def all_matches(df: DataFrame, bundle: Bundle, keys: list[str]) -> DataFrame:
    """Every enabled rule that matches, in order; all but the first are shadowed."""
    hits = F.array_compact(F.array(*[
        F.when(rule_matches(r), F.struct(F.lit(i).alias("rule_ord"), F.lit(r["name"]).alias("rule_name")))
        for i, r in enumerate(bundle.rules) if r["enabled"]]))
    return (posexploded(df, keys, hits, "pos", "r")
            .select(*keys, "r.rule_ord", "r.rule_name", (F.col("pos") > 0).alias("shadowed")))


def rule_coverage(df: DataFrame, bundle: Bundle) -> DataFrame:
    """How often each rule matched and how often it decided; rules that never match show zeros."""
    counts = (all_matches(df, bundle, []).groupBy("rule_ord")
              .agg(F.count(F.lit(1)).alias("matched"), F.count_if(~F.col("shadowed")).alias("decided")))
    table = rule_table(df.sparkSession, bundle).filter("rule_ord >= 0").select("rule_ord", "rule_name", "enabled")
    return (table.join(F.broadcast(counts), "rule_ord", "left")
            .withColumn("matched", F.coalesce("matched", F.lit(0)))
            .withColumn("decided", F.coalesce("decided", F.lit(0)))
            .withColumn("never_decides", F.col("decided") == 0))


def _action_of(bundle: Bundle, ord_col: Column) -> Column:
    out = None
    for i, rule in enumerate(bundle.rules):
        if rule["enabled"]:
            out = (F.when if out is None else out.when)(ord_col == i, rule["decision"]["action"])
    return out.otherwise(bundle.default["action"])


def backtest(df: DataFrame, old: Bundle, new: Bundle) -> DataFrame:
    """Both bundles on the same features in one projection."""
    both = df.withColumn("old_ord", F.coalesce(decided_ord(old), F.lit(-1))).withColumn("new_ord", F.coalesce(decided_ord(new), F.lit(-1)))
    return (both.withColumn("old_action", _action_of(old, F.col("old_ord")))
            .withColumn("new_action", _action_of(new, F.col("new_ord"))))


def transitions(df: DataFrame, old: Bundle, new: Bundle) -> DataFrame:
    return (backtest(df, old, new).groupBy("old_action", "new_action")
            .agg(F.count(F.lit(1)).alias("requests")))


def bundle_diff(spark, a: Bundle, b: Bundle) -> DataFrame:
    """Rules added, removed, changed or moved between two bundles."""
    def side(bundle, p):
        return rule_table(spark, bundle).filter("rule_ord >= 0").select(
            "rule_name", F.col("rule_ord").alias(f"{p}_ord"), F.col("fingerprint").alias(f"{p}_print"))
    both = side(a, "old").join(side(b, "new"), "rule_name", "full")
    change = (F.when(F.col("old_ord").isNull(), "added").when(F.col("new_ord").isNull(), "removed")
              .when(F.col("old_print") != F.col("new_print"), "changed")
              .when(F.col("old_ord") != F.col("new_ord"), "moved").otherwise("same"))
    return both.withColumn("change", change).drop("old_print", "new_print")
