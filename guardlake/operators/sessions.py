"""Session rollups, running counters and additive risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake.operators.running import running_counts
from guardlake.operators.scan import capped


def session_rollup(log: DataFrame, key: str = "session_id") -> DataFrame:
    """First and last seen and the counters of each session."""
    return log.groupBy(key).agg(
        F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("request_count"),
        F.sum("message_count").alias("total_message_count"), F.sum("attachment_count").alias("total_attachment_count"),
        F.count_if(F.col("action") == "deny").alias("refusal_count"),
        F.count_if("tool_used").alias("tool_request_count"))


def with_counters(log: DataFrame, key: str = "session_id", row_id: str = "event_id") -> DataFrame:
    """Counters as each request saw them: itself counted as a request, otherwise only earlier rows.

    Every deny is an injection attempt.  A deny with score >= 60 is an escalation
    unless it is the session's first deny, so one pass suffices: earlier such
    denies, less one if the first deny was one of them.
    """
    denied = F.col("action") == "deny"
    seen = running_counts(log, [key], ["us", row_id], "us", {
        "earlier_requests": F.lit(1), "refusal_count": denied.cast("int"), "tool_request_count": F.col("tool_used").cast("int"),
        "severe": (denied & (F.col("input_score") >= 60)).cast("int")},
        {"first_deny": F.when(denied, F.struct("us", row_id, "input_score"))})
    first_severe = F.coalesce(F.col("first_deny.input_score") >= 60, F.lit(False)).cast("int")
    return (seen.withColumn("request_count", F.col("earlier_requests") + 1)
            .withColumn("injection_attempt_count", F.col("refusal_count"))
            .withColumn("escalation_pattern_count", F.col("severe") - first_severe)
            .drop("earlier_requests", "severe", "first_deny"))


def _risk_terms() -> list[tuple[Column, int, str]]:
    c = F.col
    return [
        (c("refusal_count") >= 3, 40, "multiple_prior_refusals"),
        (c("tool_request_count") >= 5, 20, "high_tool_request_volume"),
        (c("request_count") >= 20, 15, "high_session_request_volume"),
        (c("injection_attempt_count") >= 2, 20, "cumulative_injection_attempts"),
        (c("escalation_pattern_count") >= 1, 25, "escalation_pattern_detected"),
        (c("input_score") >= 70, 20, "high_current_input_risk"),
        (c("has_control_chars"), 10, "control_chars_present"),
        (c("has_system_messages"), 15, "user_supplied_system_message"),
        (c("has_developer_messages"), 15, "user_supplied_developer_message"),
    ]


def risk_state(points: Column) -> Column:
    return (F.when(points >= 80, "blocked").when(points >= 50, "restricted")
            .when(points >= 20, "elevated").otherwise("normal"))


def session_risk(df: DataFrame) -> DataFrame:
    """Additive risk; the state looks at the sum before it is capped."""
    terms = _risk_terms()
    total = F.lit(0)
    for test, points, _ in terms:
        total = total + F.when(test, points).otherwise(0)
    df = df.withColumn("risk_points", total)
    return (df.withColumn("risk_score", capped("risk_points"))
            .withColumn("risk_state", risk_state(F.col("risk_points")))
            .withColumn("risk_reasons", F.array_compact(F.array(*[F.when(t, name) for t, _, name in terms])))
            .drop("risk_points"))


def risk_changes(df: DataFrame, key: str, order: list[str], us: str = "us") -> DataFrame:
    """Session state changes: rows whose state differs from the session's previous row.

    The last row of each (session, slot) is pre-aggregated, so the previous state
    of a slot's first row comes from a small table and a hot session spreads over
    its slots.
    """
    from pyspark.sql import Window
    from guardlake.operators.running import HOUR_US, joined
    sloted = df.withColumn("slot", F.floor(F.col(us) / HOUR_US))
    ends = sloted.groupBy(key, "slot").agg(F.max_by("risk_state", F.struct(*order)).alias("end_state"))
    prior = ends.select(key, "slot", F.lag("end_state").over(Window.partitionBy(key).orderBy("slot")).alias("slot_before"))
    local = Window.partitionBy(key, "slot").orderBy(*order)
    return (joined(sloted.withColumn("local_before", F.lag("risk_state").over(local)), prior, [key, "slot"])
            .withColumn("previous_state", F.coalesce("local_before", "slot_before"))
            .filter(F.col("previous_state").isNull() | (F.col("previous_state") != F.col("risk_state")))
            .drop("slot", "local_before", "slot_before"))


def sessionize(events: DataFrame, key: str, ts: str, gap: str = "30 minutes") -> DataFrame:
    """Sessions by inactivity gap where no session id is present."""
    return (events.groupBy(key, F.session_window(ts, gap).alias("w"))
            .agg(F.count(F.lit(1)).alias("events"))
            .select(key, F.unix_seconds("w.start").alias("start_s"), F.unix_seconds("w.end").alias("end_s"), "events"))
