"""Queries over audit events, operating figures, guard answers and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.functions import text as T
from guardlake.operators import audit as A
from guardlake.operators import evaluate as EV
from guardlake.operators import guard_model as G
from guardlake.operators import kpi as M
from guardlake.operators import normalize as N
from guardlake.operators import retrieval as R
from guardlake.operators import scan
from guardlake.plans import flow
from guardlake.plans.registry import csv, query
from guardlake.sources import tables
from guardlake.sources.pack import PAYLOADS

log = tables.fx_log


# --- audit ----------------------------------------------------------------

@query("audit_events")
def audit_events(spark, folder):
    return A.audit_events(flow.served_of(spark, folder), ["trace_id", "session_id", "subject", "tenant_id"])


@query("request_outcome")
def request_outcome(spark, folder):
    return flow.outcomes_of(spark, folder)


def stages(spark, folder):
    return A.stage_durations(tables.fx_timings(spark, folder), ["event_id", "tenant_id"])


@query("stage_durations")
def stage_durations(spark, folder):
    return stages(spark, folder).select("event_id", "stage", F.round("at_ms", 4).alias("at_ms"), F.round("stage_ms", 4).alias("stage_ms"))


@query("latency_percentiles")
def latency_percentiles(spark, folder):
    return M.latency_slo(stages(spark, folder), ["stage"])


@query("latency_rollup")
def latency_rollup(spark, folder):
    """Quantiles from hourly sketches, held against the ranks in the whole table."""
    rows = A.stage_durations(tables.fx_timings(spark, folder), ["event_id", "us"])
    found = M.rank_errors(rows, M.latency_of_rollup(M.latency_rollup(rows, ["stage"]), ["stage"]), ["stage"])
    return found.select("stage", "n", *[(F.col(f"{name}_error") <= M.SKETCH_ERROR).alias(f"{name}_in_bounds") for name, _ in M.QUANTILES])


# --- operating figures ----------------------------------------------------

@query("kpi_windows")
def kpi_windows(spark, folder):
    return M.kpi_windows(log(spark, folder), 21600)


@query("kpi_sliding")
def kpi_sliding(spark, folder):
    timed = log(spark, folder).withColumn("t", tables.as_utc(F.col("ts")))
    return M.sliding_kpis(timed, "t", "2 hours", "1 hour")


@query("kpi_stream")
def kpi_stream(spark, folder):
    from guardlake.streaming import kpi_stream
    return kpi_stream.replay(spark, folder)


@query("kpi_partials")
def kpi_partials(spark, folder):
    from guardlake.streaming import files, kpi_stream
    return kpi_stream.run_partials(files.log_stream(spark, folder), 3600, ("tenant_id",))


@query("deny_top_reasons")
def deny_top_reasons(spark, folder):
    return M.top_reasons(log(spark, folder), 3)


@query("deny_segments")
def deny_segments(spark, folder):
    return M.deny_segments(log(spark, folder))


@query("deny_spikes")
def deny_spikes(spark, folder):
    out = M.spikes(M.kpi_windows(log(spark, folder), 21600, ("tenant_id",)), dims=("tenant_id",), trail=12, sigmas=1.5)
    return out.select("tenant_id", "bucket_s", "deny_rate", F.round("baseline", 6).alias("baseline"), F.round("spread", 6).alias("spread"), "spike")


@query("deny_shifts")
def deny_shifts(spark, folder):
    kpis = M.kpi_windows(log(spark, folder), 3600, ("tenant_id",))
    both = [M.shifts(kpis, ("tenant_id",), sigmas=3.0, down=down).withColumn("direction", F.lit(name)) for name, down in (("up", False), ("down", True))]
    return both[0].unionByName(both[1])


@query("guard_health")
def guard_health(spark, folder):
    n = F.col("event_id") % 20
    reason = (F.when(n == 0, "llm_guard_timeout").when(n == 1, "llm_guard_fallback:ValueError").when(n == 2, "llm_guard_parser:heuristic_non_json")
              .when(n == 3, "llm_guard_rate_limited").otherwise("model_verdict"))
    return M.guard_health(log(spark, folder).withColumn("reason", reason))


@query("upstream_counters")
def upstream_counters(spark, folder):
    rows = log(spark, folder)
    total = M.upstream_counters(rows, ["tenant_id"])
    kinds = (rows.filter("error_type IS NOT NULL").groupBy("tenant_id").pivot("error_type", ["timeout", "http_error"]).agg(F.count(F.lit(1))))
    return total.join(kinds, "tenant_id", "left").na.fill(0, ["timeout", "http_error"])


@query("incident_triage")
def incident_triage(spark, folder):
    c = F.col
    kind = (F.when(c("output_action") == "block", "output_block").when(c("tool_blocked") & (c("event_id") % 3 == 0), "unsafe_tool")
            .when(F.contains("reason_code", F.lit("INJECTION")), "prompt_leakage").when(c("action") == "deny", "deny").otherwise("other"))
    return A.incident_triage(log(spark, folder).withColumn("event_type", kind), "session_id")


@query("trace_lookup")
def trace_lookup(spark, folder):
    rows = log(spark, folder)
    wanted = rows.filter((F.col("action") == "deny") & (F.col("input_score") >= 98)).select("session_id").distinct()
    return A.trace_lookup(rows.select("event_id", "session_id", "action", "reason_code", "us"), wanted, "session_id")


@query("retrieval_drop_ratio")
def retrieval_drop_ratio(spark, folder):
    rows = log(spark, folder).withColumns({"candidates": F.lit(10), "filtered_out": F.col("event_id") % 7})
    return M.drop_ratio(rows)


@query("before_after")
def before_after(spark, folder):
    return M.before_after(log(spark, folder), 1_705_363_200_000_000, ["tenant_id"])


@query("alert_lag")
def alert_lag(spark, folder):
    rows = log(spark, folder)
    serious = rows.filter((F.col("action") == "deny") & (F.col("input_score") >= 60)).select("subject", "us", "event_id")
    alerts = rows.filter(F.col("action") == "challenge").select("subject", "us")
    return M.alert_lag(serious, alerts, ["subject"]).select("subject", "event_id", "us", "alert_us", "lag_us", "in_time")


# --- guard-model answers --------------------------------------------------

@query("parse_guard")
def parse_guard(spark, folder):
    return G.parse_guard(tables.fx_guard_raw(spark, folder)).select("trace_id", "parser_source", F.get_json_object("guard_json", "$.label").alias("raw_label"))


@query("normalize_guard")
def normalize_guard(spark, folder):
    n = G.normalize_guard(G.parse_guard(tables.fx_guard_raw(spark, folder)))
    return n.select("trace_id", "guard_label", "guard_action", "guard_confidence", "guard_risk", csv("guard_reasons").alias("guard_reasons"))


@query("infer_guard_label")
def infer_guard_label(spark, folder):
    rows = tables.fx_guard_raw(spark, folder).withColumn("label", G.infer_label(F.col("raw_text")))
    docs = tables.table(spark, folder, "documents").select((-F.col("doc_id") - 1).alias("trace_id"), G.infer_label(F.col("text")).alias("label"))
    both = rows.select("trace_id", "label").unionByName(docs)
    return both.select("trace_id", "label", G.default_number(F.col("label"), 0).alias("risk_score"),
                       G.default_number(F.col("label"), 1).cast("double").alias("confidence"))


@query("infer_guard_action")
def infer_guard_action(spark, folder):
    return tables.fx_guard_raw(spark, folder).select("trace_id", G.infer_action(F.col("raw_text")).alias("action"))


# --- evaluation -----------------------------------------------------------

@query("regression_pack")
def regression_pack(spark, folder):
    """Every message gets one of the labelled payloads by key arithmetic."""
    pack = spark.createDataFrame([(i, p, e) for i, (p, e) in enumerate(PAYLOADS)], "n int, addition string, expected_label string")
    rows = N.normalize(tables.fx_messages(spark, folder)).withColumn("n", ((F.col("conv_id") * 7 + F.col("turn") * 11) % len(PAYLOADS)).cast("int"))
    packed = rows.join(F.broadcast(pack), "n").withColumn("payload", F.concat_ws(" ", "content", "addition"))
    return EV.regression(packed)


@query("detector_quality")
def detector_quality(spark, folder):
    docs = tables.table(spark, folder, "documents")
    scored = scan.score_columns(scan.with_signals(docs, "text")).select("doc_id", (F.col("signal_count") > 0).alias("flagged"))
    return EV.quality(scored, tables.table(spark, folder, "labels"))


@query("corpus_scan")
def corpus_scan(spark, folder):
    docs = tables.table(spark, folder, "documents").select("source", "lang", "text")
    pages = tables.table(spark, folder, "pages").select(F.lit("page").alias("source"), F.lit("html").alias("lang"), F.col("html").alias("text"))
    return EV.corpus_scan(docs.unionByName(pages), ["source", "lang"])


@query("corpus_riskiest")
def corpus_riskiest(spark, folder):
    return EV.riskiest(tables.table(spark, folder, "documents"), "doc_id")
