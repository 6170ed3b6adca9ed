"""Audit events, decision records, outcomes and forensics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.functions.rows import exploded, posexploded


def _event(kind: str, severity, detail: Column) -> Column:
    severity = severity if isinstance(severity, Column) else F.lit(severity)
    return F.struct(F.lit(kind).alias("event_type"), severity.alias("severity"), detail.alias("detail"))


def audit_events(df: DataFrame, keys: list[str]) -> DataFrame:
    """Up to six events per request, in emission order, from one wide row. Rate-limited and over-budget requests leave none.

    Needs ``action``, ``reason_codes``, ``input_score``, ``input_labels``, ``dlp_score``,
    ``dlp_labels``, ``blocked_tools`` (array), ``output_action``, ``residual_count``.
    """
    c = F.col
    joined = lambda name: F.array_join(name, ",")
    events = F.array_compact(F.array(
        F.when(c("action").isin("deny", "challenge"),
               _event("policy_decision", "high", F.concat_ws(":", "action", joined("reason_codes")))),
        F.when(c("input_score") >= 50,
               _event("high_risk_input_scan", "high", F.concat_ws(":", c("input_score").cast("string"), joined("input_labels")))),
        F.when(c("dlp_score") >= 20,
               _event("dlp_detection", F.when(c("dlp_score") >= 40, "high").otherwise("medium"),
                      F.concat_ws(":", c("dlp_score").cast("string"), joined("dlp_labels")))),
        F.when(F.size("blocked_tools") > 0, _event("tool_blocked", "medium", joined("blocked_tools"))),
        F.when(c("output_action").isin("redact", "block"),
               _event("output_guard_action", F.when(c("output_action") == "block", "high").otherwise("medium"), c("output_action"))),
        F.when(c("residual_count") > 0,
               _event("prompt_pii_residual_alert", "high", c("residual_count").cast("string")))))
    df = df.filter(~F.col("outcome").isin("rate_limited", "budget_exceeded")) if "outcome" in df.columns else df
    return (posexploded(df, keys, events, "event_pos", "e")
            .select(*keys, "event_pos", "e.event_type", "e.severity", "e.detail"))


def recent_events(events: DataFrame, limit: int = 100, offset: int = 0, order=("us", "event_id"),
                  skip_newest: bool = False) -> DataFrame:
    """Newest events, oldest of them first.  The page is cut from the newest ``limit + offset``
    events at its old end, so ``offset`` drops the oldest of those; with ``skip_newest`` it
    skips the newest instead, as a reader would expect of a page."""
    limit, offset = max(1, min(limit, 10000)), max(0, offset)
    newest = events.orderBy(*[F.desc(c) for c in order])
    if skip_newest:
        return newest.offset(offset).limit(limit)
    return newest.limit(limit + offset).orderBy(*order).offset(offset)


def outcome(df: DataFrame) -> DataFrame:
    """First stage that stopped the request, with its status class."""
    c = F.col
    status = (F.when(~c("rate_allowed"), "rate_limited").when(c("action") == "deny", "denied")
              .when(c("action") == "challenge", "challenge").when(c("budget_outcome") == "block", "budget_exceeded")
              .when(c("output_action") == "block", "blocked_output").otherwise("ok"))
    df = df.withColumn("outcome", status)
    code = (F.when(c("outcome") == "rate_limited", 429).when(c("outcome").isin("denied", "challenge"), 403)
            .when(c("outcome") == "budget_exceeded", 413).when(c("outcome") == "blocked_output", 502).otherwise(200))
    return df.withColumn("status_code", code)


def decision_records(df: DataFrame) -> DataFrame:
    """One wide record per logged request.  Rate-limited and over-budget requests leave none.

    Stage times are kept where the row has them (``timings_ms``).
    """
    logged = df.filter(~F.col("outcome").isin("rate_limited", "budget_exceeded"))
    return logged.select(
        "trace_id", "session_id", "subject", "tenant_id",
        F.struct("message_count", "attachment_count", "requested_tool_count",
                 F.coalesce("allow_retrieval", F.lit(False)).alias("retrieval_allowed")).alias("request_summary"),
        F.struct(F.struct("risk_score", "risk_state").alias("session_risk"),
                 F.struct("input_score", "input_labels").alias("input_scan"),
                 F.struct("dlp_score", "dlp_labels").alias("dlp_scan"),
                 F.struct("label", "confidence").alias("content_classification"),
                 F.struct("action", "reason_codes").alias("policy_decision"),
                 F.struct("guard_label", "guard_confidence", "guard_risk", "guard_action").alias("llm_input_guard"),
                 F.struct("allowed_chunks", "dropped_chunks").alias("retrieval_summary"),
                 F.col("tool_decisions"),
                 F.struct("output_action", "output_reasons", "output_signals").alias("output_guard")).alias("decisions"),
        *[c for c in ("timings_ms",) if c in df.columns],
        F.struct("outcome", "output_action").alias("outcome_record"))


def stage_durations(log: DataFrame, keys: list[str], timings: str = "timings_ms") -> DataFrame:
    """Stage times from cumulative marks: each mark less the one before it.

    The marks of one request are a small map, so they are ordered inside the row.
    """
    marks = F.array_sort(F.transform(F.map_entries(timings), lambda e: F.struct(e["value"].alias("at"), e["key"].alias("stage"))))
    log = log.withColumn("_m", marks)
    steps = F.transform("_m", lambda m, i: F.struct(
        m["stage"].alias("stage"), i.alias("stage_pos"), m["at"].alias("at_ms"),
        (m["at"] - F.when(i > 0, F.get("_m", i - 1)["at"]).otherwise(0.0)).alias("stage_ms")))
    return exploded(log, keys, steps, "s").select(*keys, "s.stage", "s.stage_pos", "s.at_ms", "s.stage_ms")


def trace_lookup(events: DataFrame, wanted: DataFrame, key: str) -> DataFrame:
    """All events of the wanted traces or sessions."""
    return events.join(wanted, key, "left_semi")


def incident_triage(events: DataFrame, key: str, repeated: int = 3) -> DataFrame:
    """Severity per subject from its event mix."""
    c = F.count_if
    mix = events.groupBy(key).agg(
        c(F.col("event_type") == "output_block").alias("blocked_outputs"),
        c(F.col("event_type") == "unsafe_tool").alias("unsafe_tools"),
        c(F.col("event_type") == "prompt_leakage").alias("leak_attempts"),
        c(F.col("event_type") == "deny").alias("denials"))
    high = (F.col("unsafe_tools") > 0) | (F.col("blocked_outputs") >= repeated)
    medium = (F.col("leak_attempts") > 0) | (F.col("denials") >= repeated)
    return (mix.withColumn("triage", F.when(high, "high").when(medium, "medium").otherwise("low"))
            .withColumn("repeated_denials", F.col("denials") >= repeated))
