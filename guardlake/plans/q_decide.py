"""Queries over sessions, limits, classification and policy."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.operators import classify as K
from guardlake.operators import limits as L
from guardlake.operators import policy as P
from guardlake.operators import rule_index as RI
from guardlake.operators import sessions as S
from guardlake.plans import flow
from guardlake.plans.registry import csv, query
from guardlake.sources import tables
from guardlake.sources.bundle import shipped

log = tables.fx_log


# --- sessions -------------------------------------------------------------

@query("session_rollup")
def session_rollup(spark, folder):
    return S.session_rollup(log(spark, folder))


@query("session_running")
def session_running(spark, folder):
    return S.with_counters(log(spark, folder)).select("event_id", "session_id", "request_count", "refusal_count", "tool_request_count")


@query("injection_attempts")
def injection_attempts(spark, folder):
    return S.with_counters(log(spark, folder)).select("event_id", "session_id", "injection_attempt_count", "escalation_pattern_count")


def risk_rows(spark, folder):
    seen = S.with_counters(log(spark, folder))
    return S.session_risk(seen.withColumns({
        "has_control_chars": F.col("event_id") % 11 == 0, "has_system_messages": F.col("event_id") % 13 == 0,
        "has_developer_messages": F.col("event_id") % 17 == 0}))


@query("session_risk")
def session_risk(spark, folder):
    return risk_rows(spark, folder).select("event_id", "risk_score", "risk_state", csv("risk_reasons").alias("risk_reasons"))


@query("risk_history")
def risk_history(spark, folder):
    rows = risk_rows(spark, folder).select("session_id", "us", "event_id", "risk_score", "risk_state")
    changes = S.risk_changes(rows, "session_id", ["us", "event_id"]).groupBy("session_id").agg(F.count(F.lit(1)).alias("state_changes"))
    order = F.struct("us", "event_id")
    ends = rows.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("history_length"), F.max("risk_score").alias("peak_score"),
        F.max_by("risk_score", order).alias("last_score"), F.max_by("risk_state", order).alias("last_state"))
    return ends.join(changes, "session_id")


@query("stream_session_state")
def stream_session_state(spark, folder):
    from guardlake.streaming import state
    return state.replay_sessions(spark, folder)


@query("session_gap_windows")
def session_gap_windows(spark, folder):
    ev = tables.table(spark, folder, "events").withColumn("t", tables.as_utc(F.col("ts")))
    return S.sessionize(ev, "user_id", "t")


# --- limits and profiles --------------------------------------------------

@query("sliding_hits")
def sliding_hits(spark, folder):
    hour = L.sliding_hits(log(spark, folder), window_s=3600, name="hits_hour")
    return L.sliding_hits(hour).select("event_id", "client_id", "subject", "current_hits", "hits_hour")


def verdicts(spark, folder):
    return L.rate_verdict(log(spark, folder))


@query("effective_limit")
def effective_limit(spark, folder):
    return verdicts(spark, folder).select("event_id", "input_score", "injections_before", "limit_multiplier", "effective_limit")


@query("rate_limit_offline")
def rate_limit_offline(spark, folder):
    return verdicts(spark, folder).groupBy("verdict", "action").agg(
        F.count(F.lit(1)).alias("requests"), F.sum("current_hits").alias("hits"), F.sum("event_id").alias("id_sum"))


@query("rate_limit_exact")
def rate_limit_exact(spark, folder):
    from guardlake.streaming import state
    return state.replay_limits(spark, folder)


@query("rate_limit_rounds")
def rate_limit_rounds(spark, folder):
    """The exact replay over the whole table by rounds: every request with the counters it saw, its verdict and its decision."""
    from guardlake.streaming import state
    return state.replay_table(spark, folder)


AS_OF_US = 1_706_745_600_000_000  # 2024-02-01 00:00:00 UTC, past the end of the log: the age of profiles is taken then


def denials(spark, folder):
    return log(spark, folder).filter(F.col("action") == "deny")


@query("attacker_profiles")
def attacker_profiles(spark, folder):
    return L.profiles(denials(spark, folder))


@query("top_reason")
def top_reason(spark, folder):
    return L.top_reason(denials(spark, folder))


@query("suspicious_clients")
def suspicious_clients(spark, folder):
    p = L.profiles(denials(spark, folder))
    return p.select("client_id", "subject", "refusal_count", L.suspicious(F.lit(AS_OF_US)).alias("suspicious"))


@query("limit_multiplier")
def limit_multiplier(spark, folder):
    p = L.profiles(denials(spark, folder))
    m = L.multiplier(F.col("jailbreak_attempts"), F.col("escalation_attempts"), F.col("injection_attempts"))
    return p.select("client_id", "subject", m.alias("limit_multiplier"))


@query("recent_alerts")
def recent_alerts(spark, folder):
    d = denials(spark, folder)
    newest = L.alerts(L.profiles(d), F.lit(AS_OF_US), 50)
    return newest.join(L.top_reason(d), L.LIMIT_KEY).select(
        *L.LIMIT_KEY, "refusal_count", "jailbreak_attempts", "escalation_attempts", "tool_abuse_attempts", "last_us", "reason_cluster")


@query("profile_retention")
def profile_retention(spark, folder):
    return L.retain(L.profiles(denials(spark, folder)), 60).select(*L.LIMIT_KEY, "first_us")


@query("guard_call_budget")
def guard_call_budget(spark, folder):
    return L.call_budget(log(spark, folder).select("event_id", "us"), window_s=3600)


# --- classification -------------------------------------------------------

@query("classify_deterministic")
def classify_deterministic(spark, folder):
    c = K.classify(flow.with_offline_risk(flow.features_of(spark, folder)))
    return c.select("trace_id", "label", "confidence", csv("reasons").alias("reasons"))


def guarded(spark, folder):
    f = flow.with_offline_risk(flow.features_of(spark, folder))
    return K.classify_with_guard(f.join(tables.fx_guard(spark, folder), "trace_id", "left"))


@query("classify_with_guard")
def classify_with_guard(spark, folder):
    return guarded(spark, folder).select("trace_id", "label", "confidence", csv("reasons").alias("reasons"))


@query("class_features")
def class_features(spark, folder):
    f = K.class_features(guarded(spark, folder)).select("trace_id", "features.*")
    return f.withColumn("input_labels", csv("input_labels")).withColumn("dlp_labels", csv("dlp_labels"))


# --- policy ---------------------------------------------------------------

def classified(spark, folder):
    return K.classify(flow.with_offline_risk(flow.features_of(spark, folder)))


def distinct_conditions():
    seen = {}
    for rule in shipped().rules:
        for key, value in rule["condition"].items():
            seen[f"{key}={value}"] = (key, value)
    return seen


@query("policy_conditions")
def policy_conditions(spark, folder):
    kinds = distinct_conditions()
    wide = classified(spark, folder).agg(*[F.count_if(P.condition(k, v)).alias(f"c{i}") for i, (k, v) in enumerate(kinds.values())])
    return wide.select(F.explode(F.array(*[F.struct(F.lit(n).alias("condition"), F.col(f"c{i}").alias("requests"))
                                           for i, n in enumerate(kinds)])).alias("x")).select("x.*")


@query("policy_decide")
def policy_decide(spark, folder):
    return flow.decisions_of(spark, folder).select("trace_id", "rule_name", "action", csv("reason_codes").alias("reason_code"))


@query("policy_all_matches")
def policy_all_matches(spark, folder):
    return P.all_matches(classified(spark, folder), shipped(), ["trace_id"])


@query("rule_coverage")
def rule_coverage(spark, folder):
    return P.rule_coverage(classified(spark, folder), shipped())


@query("policy_backtest")
def policy_backtest(spark, folder):
    return P.transitions(classified(spark, folder), shipped(), shipped("candidate"))


@query("policy_decide_indexed")
def policy_decide_indexed(spark, folder):
    """The deciding rule by the index of condition bits."""
    return classified(spark, folder).select("trace_id", F.coalesce(RI.decided_ord(shipped()), F.lit(-1)).alias("rule_ord"))


@query("policy_backtest_indexed")
def policy_backtest_indexed(spark, folder):
    return RI.transitions(classified(spark, folder), shipped(), shipped("candidate"))


@query("rule_implications")
def rule_implications(spark, folder):
    """Pairs of rules of which one implies the other, and how often the narrower of them matches in the table."""
    found = RI.implications(spark, shipped())
    hits = classified(spark, folder).select(F.explode(RI.matches(shipped())).alias("rule")).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))
    narrow = F.when(F.col("relation") == "exception", F.col("earlier")).otherwise(F.col("later"))
    return found.withColumn("rule", narrow).join(hits, "rule", "left").select("earlier", "later", "relation", "same_decision", F.coalesce("n", F.lit(0)).alias("requests"))


@query("policy_controls")
def policy_controls(spark, folder):
    return flow.decisions_of(spark, folder).select(
        "trace_id", "disable_tools", "allow_retrieval", "max_context_sensitivity", "require_human_approval",
        "response_mode", "enforce_token_budget")


@query("bundle_diff")
def bundle_diff(spark, folder):
    both = P.backtest(classified(spark, folder), shipped(), shipped("candidate"))
    by = lambda col, name: both.groupBy(F.col(col)).agg(F.count(F.lit(1)).alias(name))
    return (P.bundle_diff(spark, shipped(), shipped("candidate"))
            .join(by("old_ord", "old_decided"), "old_ord", "left").join(by("new_ord", "new_decided"), "new_ord", "left")
            .select("rule_name", "old_ord", "new_ord", "change", F.coalesce("old_decided", F.lit(0)).alias("old_decided"),
                    F.coalesce("new_decided", F.lit(0)).alias("new_decided")))
