"""Rows whose key is null stay in running counts, state changes, quantiles and alert lags, as one key of their own."""

from pyspark.sql import functions as F

from guardlake.operators import kpi, limits, sessions
from guardlake.operators.running import running_counts


def log_rows(spark, n=60):
    """A decision log in which every third client, every fourth session and every seventh subject is null."""
    return spark.range(n).select(
        F.col("id").alias("event_id"), (F.col("id") * 1_700_000_000).alias("us"),
        F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("client_id"), F.when(F.col("id") % 4 > 0, F.col("id") % 5).alias("session_id"),
        F.when(F.col("id") % 7 > 0, F.lit("s")).alias("subject"), (F.col("id") % 90).cast("int").alias("input_score"),
        F.when(F.col("id") % 6 == 0, "deny").otherwise("allow").alias("action"), (F.col("id") % 2 == 0).alias("tool_used"),
        F.array(F.lit("JAILBREAK_ATTEMPT_DETECTED")).alias("reason_codes"),
        *[F.lit(False).alias(c) for c in ("has_control_chars", "has_system_messages", "has_developer_messages")])


def test_running_counts(spark):
    log = log_rows(spark)
    rows = sorted(log.collect(), key=lambda r: r["us"])
    got = {r["event_id"]: r["n"] for r in running_counts(log, ["client_id", "subject"], ["us"], "us", {"n": F.lit(1)}).collect()}
    want = {r["event_id"]: sum((a["client_id"], a["subject"]) == (r["client_id"], r["subject"]) and a["us"] < r["us"] for a in rows) for r in rows}
    assert got == want


def test_limits_and_sessions(spark):
    log = log_rows(spark)
    assert limits.rate_verdict(log).count() == 60
    risk = sessions.session_risk(sessions.with_counters(log))
    assert risk.count() == 60
    plain = {}
    for r in sorted(risk.collect(), key=lambda r: r["us"]):
        plain.setdefault(r["session_id"], []).append((r["event_id"], r["risk_state"]))
    want = {rows[i][0] for rows in plain.values() for i in range(len(rows)) if i == 0 or rows[i][1] != rows[i - 1][1]}
    assert {r["event_id"] for r in sessions.risk_changes(risk, "session_id", ["us", "event_id"]).collect()} == want
    assert None in plain


def test_quantiles(spark):
    rows = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 2.0)], "stage string, stage_ms double")
    got = {r["stage"]: (r["n"], r["p50"]) for r in kpi.latency_slo(rows, ["stage"]).collect()}
    assert got == {None: (2, 2.0), "a": (1, 2.0)}


def test_alert_of_the_next_hour(spark):
    events = spark.createDataFrame([(None, 1_000_000, 1), ("k", 1_000_000, 2)], "k string, us long, event_id long")
    alerts = spark.createDataFrame([(None, 4_000_000_000), ("k", 4_000_000_000)], "k string, us long")
    got = {r["event_id"]: r["alert_us"] for r in kpi.alert_lag(events, alerts, ["k"]).collect()}
    assert got == {1: 4_000_000_000, 2: 4_000_000_000}
