"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line on stdout."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "input_scan_rollup", "signals_long", "dlp_rollup", "dlp_evidence", "redact_pii", "redaction_counts", "corpus_scan",
    "dlp_corpus_profile", "session_risk", "rate_limit_offline", "attacker_profiles", "top_reason", "policy_decide",
    "policy_backtest", "rule_coverage", "retrieval_funnel", "chunk_dlp", "tool_execution_records", "prompt_render",
    "output_action", "audit_events", "kpi_windows", "deny_segments", "alert_lag", "normalize_guard", "kpi_stream", "rate_limit_exact",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    from guardlake.plans.registry import all_queries
    from guardlake.spark import build_session
    spark = build_session("guardlake-bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    queries = all_queries()
    queries["kpi_windows"](spark, folder).count()  # start the session's threads and code paths
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
