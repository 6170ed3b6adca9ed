"""Oracle SQL for audit events, operating figures, guard answers and evaluation."""

from __future__ import annotations

from guardlake import catalog as C
from guardlake.sources import tables as T
from guardlake.sources.pack import PAYLOADS
from oracle import serve  # noqa: F401  (adds the CTE of served requests)
from oracle.base import CTE, REJECTED, UPTO, big, label_sql, points_sql, q, scan_columns, sql

SQL: dict[str, str] = {}

# --- audit ----------------------------------------------------------------

_kinds = (
    ("policy_decision", "'high'", "action || ':' || reason_code", "action IN ('deny', 'challenge')"),
    ("high_risk_input_scan", "'high'", "input_score || ':' || input_labels", "input_score >= 50"),
    ("dlp_detection", "CASE WHEN dlp_score >= 40 THEN 'high' ELSE 'medium' END", "dlp_score || ':' || dlp_labels", "dlp_score >= 20"),
    ("tool_blocked", "'medium'", "blocked_tools", "blocked_tools <> ''"),
    ("output_guard_action", "CASE WHEN output_action = 'block' THEN 'high' ELSE 'medium' END", "output_action", "output_action IN ('redact', 'block')"),
    ("prompt_pii_residual_alert", "'high'", "CAST(residual_count AS VARCHAR)", "residual_count > 0"),
)
SQL["audit_events"] = sql("SELECT * EXCLUDE (o), CAST(row_number() OVER (PARTITION BY trace_id ORDER BY o) - 1 AS INT) AS event_pos FROM (" + " UNION ALL ".join(
    f"SELECT trace_id, session_id, subject, tenant_id, {i} AS o, {q(kind)} AS event_type, {severity} AS severity, {detail} AS detail FROM served WHERE outcome NOT IN ('rate_limited', 'budget_exceeded') AND {test}"
    for i, (kind, severity, detail, test) in enumerate(_kinds)) + ") e", "served")
SQL["request_outcome"] = sql(f"""SELECT trace_id, rate_allowed, outcome, status_code, CAST(NULL AS VARCHAR) AS reject_reason FROM served
 UNION ALL SELECT q.trace_id, NULL, 'rejected', CASE WHEN bad > 0 THEN 422 ELSE 413 END, CASE WHEN bad > 0 THEN 'invalid_message' ELSE 'too_large' END FROM
 (SELECT conv_id, turn, role, sum(CASE WHEN {REJECTED} THEN 1 ELSE 0 END) {UPTO} AS bad, sum(strlen(content)) {UPTO} AS total FROM fx_messages) m
 JOIN fx_requests q USING (conv_id, turn) WHERE role = 'user' AND (bad > 0 OR total > {C.MAX_REQUEST_BYTES})""", "served", "fx_messages", "fx_requests")
_marks = " UNION ALL ".join(
    f"SELECT event_id, tenant_id, {q(name)} AS stage, {i} AS o, latency_ms * {k} AS at_ms, latency_ms * {k} - latency_ms * {T.MARKS[i - 1][1] if i else 0} AS stage_ms FROM fx_log"
    for i, (name, k) in enumerate(T.MARKS))
CTE["stages"] = (("fx_log",), _marks)
SQL["stage_durations"] = sql("SELECT event_id, stage, round(CAST(at_ms AS DOUBLE), 4) AS at_ms, round(CAST(stage_ms AS DOUBLE), 4) AS stage_ms FROM stages", "stages")
SQL["latency_percentiles"] = sql("SELECT *, p50 < 50 AS p50_met, p95 < 150 AS p95_met, p99 < 300 AS p99_met FROM (SELECT stage, count(*) AS n, "
                                 + ", ".join(f"round(quantile_cont(CAST(stage_ms AS DOUBLE), {v}), 4) AS {n}" for n, v in (("p50", 0.5), ("p95", 0.95), ("p99", 0.99)))
                                 + " FROM stages GROUP BY stage) s", "stages")
SQL["latency_rollup"] = sql("SELECT stage, count(*) AS n, TRUE AS p50_in_bounds, TRUE AS p95_in_bounds, TRUE AS p99_in_bounds FROM stages GROUP BY stage", "stages")

# --- operating figures ----------------------------------------------------

_kpis = """count(*) AS requests, count(*) FILTER (WHERE action = 'deny') AS denied, count(*) FILTER (WHERE action = 'challenge') AS challenged,
 count(*) FILTER (WHERE input_score >= 50) AS high_risk_inputs, count(*) FILTER (WHERE dlp_score >= 20) AS dlp_detections, count(*) FILTER (WHERE tool_blocked) AS tools_blocked,
 count(*) FILTER (WHERE output_action = 'redact') AS outputs_redacted, count(*) FILTER (WHERE output_action = 'block') AS outputs_blocked"""
_bucket = lambda w: f"{big(f'us // {w * 1000000} * {w}')} AS bucket_s"
SQL["kpi_windows"] = sql(f"SELECT *, round(denied / requests, 6) AS deny_rate FROM (SELECT {_bucket(21600)}, {_kpis} FROM fx_log GROUP BY bucket_s) k", "fx_log")
SQL["kpi_sliding"] = sql(f"SELECT start_s, {_kpis} FROM (SELECT *, us // 3600000000 * 3600 AS start_s FROM fx_log UNION ALL SELECT *, us // 3600000000 * 3600 - 3600 FROM fx_log) s GROUP BY start_s", "fx_log")
SQL["kpi_stream"] = sql(f"SELECT {_bucket(3600)}, {_kpis} FROM fx_log GROUP BY bucket_s", "fx_log")
SQL["kpi_partials"] = sql(f"SELECT *, round(denied / requests, 6) AS deny_rate FROM (SELECT tenant_id, {_bucket(3600)}, {_kpis} FROM fx_log GROUP BY tenant_id, bucket_s) k", "fx_log")
SQL["deny_top_reasons"] = sql("SELECT reason_code, count(*) AS denials FROM fx_log WHERE action = 'deny' GROUP BY reason_code ORDER BY denials DESC, reason_code LIMIT 3", "fx_log")
SQL["deny_segments"] = sql("SELECT subject, tenant_id, client_id, count(*) AS denials, CAST(grouping_id(subject, tenant_id, client_id) AS INT) AS level FROM fx_log WHERE action = 'deny' GROUP BY CUBE (subject, tenant_id, client_id)", "fx_log")
SQL["deny_spikes"] = sql(f"""SELECT tenant_id, bucket_s, deny_rate, round(baseline, 6) AS baseline, round(spread, 6) AS spread, coalesce(deny_rate > baseline + 1.5 * spread, FALSE) AS spike FROM
 (SELECT *, avg(deny_rate) OVER w AS baseline, stddev_samp(deny_rate) OVER w AS spread FROM (SELECT tenant_id, {_bucket(21600)}, round(count(*) FILTER (WHERE action = 'deny') / count(*), 6) AS deny_rate
  FROM fx_log GROUP BY tenant_id, bucket_s) k WINDOW w AS (PARTITION BY tenant_id ORDER BY bucket_s ROWS BETWEEN 12 PRECEDING AND 1 PRECEDING)) s""", "fx_log")
_beyond = {"up": "denied - requests * (d / n + 0.02)", "down": "requests * (d / n - 0.02) - denied"}
SQL["deny_shifts"] = sql(f"""SELECT * FROM (WITH hours AS (SELECT tenant_id, {_bucket(3600)}, count(*) AS requests, count(*) FILTER (WHERE action = 'deny') AS denied FROM fx_log GROUP BY ALL),
 whole AS (SELECT tenant_id, sum(requests)::DOUBLE AS n, sum(denied)::DOUBLE AS d, count(*) AS buckets FROM hours GROUP BY tenant_id),
 each AS ({' UNION ALL '.join(f"SELECT *, {q(k)} AS direction, CAST(floor(({e}) * 1000000) AS BIGINT) AS e FROM hours JOIN whole USING (tenant_id)" for k, e in _beyond.items())}),
 sums AS (SELECT *, sum(e) OVER (PARTITION BY tenant_id, direction ORDER BY bucket_s) AS s FROM each),
 excess AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY tenant_id, direction ORDER BY bucket_s)) AS x FROM sums)
 SELECT tenant_id, bucket_s, requests, denied, direction, x / 1000000.0 AS excess, CASE WHEN x > 0 THEN max(CASE WHEN x = 0 THEN bucket_s END) OVER (PARTITION BY tenant_id, direction ORDER BY bucket_s) END AS zero_s,
 x / 1000000.0 > 3.0 * sqrt(n / buckets * (d / n) * (1 - d / n)) AS shifted FROM excess)""", "fx_log")
SQL["guard_health"] = sql(f"""SELECT *, round((timeouts + fallbacks + malformed + rate_limited) / calls, 6) AS degraded_rate FROM (SELECT {_bucket(86400)}, count(*) AS calls, count(*) FILTER (WHERE event_id % 20 = 0) AS timeouts,
 count(*) FILTER (WHERE event_id % 20 = 1) AS fallbacks, count(*) FILTER (WHERE event_id % 20 = 2) AS malformed, count(*) FILTER (WHERE event_id % 20 = 3) AS rate_limited FROM fx_log GROUP BY bucket_s) h""", "fx_log")
SQL["upstream_counters"] = sql("""SELECT tenant_id, count(*) FILTER (WHERE error_type IS NULL) AS upstream_success, count(error_type) AS upstream_failure, count(error_type) FILTER (WHERE fail_open) AS fail_open,
 count(error_type) FILTER (WHERE NOT fail_open) AS fail_closed, count(*) FILTER (WHERE error_type = 'timeout') AS timeout, count(*) FILTER (WHERE error_type = 'http_error') AS http_error FROM fx_log GROUP BY tenant_id""", "fx_log")
SQL["incident_triage"] = sql("""SELECT *, CASE WHEN unsafe_tools > 0 OR blocked_outputs >= 3 THEN 'high' WHEN leak_attempts > 0 OR denials >= 3 THEN 'medium' ELSE 'low' END AS triage, denials >= 3 AS repeated_denials FROM
 (SELECT session_id, count(*) FILTER (WHERE k = 'output_block') AS blocked_outputs, count(*) FILTER (WHERE k = 'unsafe_tool') AS unsafe_tools, count(*) FILTER (WHERE k = 'prompt_leakage') AS leak_attempts,
  count(*) FILTER (WHERE k = 'deny') AS denials FROM (SELECT session_id, CASE WHEN output_action = 'block' THEN 'output_block' WHEN tool_blocked AND event_id % 3 = 0 THEN 'unsafe_tool'
  WHEN contains(reason_code, 'INJECTION') THEN 'prompt_leakage' WHEN action = 'deny' THEN 'deny' ELSE 'other' END AS k FROM fx_log) x GROUP BY session_id) y""", "fx_log")
SQL["trace_lookup"] = sql("SELECT event_id, session_id, action, reason_code, us FROM fx_log WHERE session_id IN (SELECT session_id FROM fx_log WHERE action = 'deny' AND input_score >= 98)", "fx_log")
SQL["retrieval_drop_ratio"] = sql(f"SELECT *, round(filtered_out / candidates, 6) AS drop_ratio FROM (SELECT {_bucket(86400)}, {big('sum(event_id % 7)')} AS filtered_out, {big('sum(10)')} AS candidates FROM fx_log GROUP BY bucket_s) d", "fx_log")
_at = 1_705_363_200_000_000
SQL["before_after"] = sql(f"""SELECT tenant_id, count(*) FILTER (WHERE us < {_at}) AS before_requests, count(*) FILTER (WHERE us < {_at} AND action = 'deny') AS before_denied,
 count(*) FILTER (WHERE us >= {_at}) AS after_requests, count(*) FILTER (WHERE us >= {_at} AND action = 'deny') AS after_denied FROM fx_log GROUP BY tenant_id""", "fx_log")
SQL["alert_lag"] = sql("""SELECT e.subject, e.event_id, e.us, a.us AS alert_us, a.us - e.us AS lag_us, coalesce(a.us - e.us < 300000000, FALSE) AS in_time FROM
 (SELECT * FROM fx_log WHERE action = 'deny' AND input_score >= 60) e ASOF LEFT JOIN (SELECT DISTINCT subject, us FROM fx_log WHERE action = 'challenge') a ON e.subject = a.subject AND a.us >= e.us""", "fx_log")

# --- guard-model answers --------------------------------------------------

_shape = "(conv_id + turn * 3) % 9"
_source = f"CASE {_shape} WHEN 0 THEN 'json' WHEN 1 THEN 'json' WHEN 2 THEN 'embedded_json' WHEN 5 THEN 'json' WHEN 6 THEN 'json' WHEN 7 THEN 'not_an_object' ELSE 'heuristic_non_json' END"
SQL["parse_guard"] = f"""SELECT conv_id * 1000000 + turn AS trace_id, {_source} AS parser_source, CASE {_shape} WHEN 0 THEN 'prompt_injection' WHEN 1 THEN 'benign' WHEN 2 THEN 'Jailbreak_Attempt '
 WHEN 5 THEN 'odd' WHEN 6 THEN 'sensitive_data_submission' END AS raw_label FROM conversations WHERE role = 'user'"""


def infer_label(text: str) -> str:
    low = f"lower({text})"
    has = lambda w: f"contains({low}, {q(w)})"
    groups = " ".join(f"WHEN {' OR '.join(has(w) for w in words)} THEN {q(label)}" for label, words in C.GUARD_KEYWORDS)
    return f"CASE WHEN {has('safe')} AND NOT {has('unsafe')} THEN 'benign' {groups} WHEN {has('unsafe')} THEN 'unsafe_output' ELSE 'suspicious' END"


def infer_action(text: str) -> str:
    has = lambda w: f"contains(lower({text}), {q(w)})"
    return (f"CASE WHEN {has('block')} THEN 'block' WHEN {has('deny')} THEN 'deny' WHEN {has('redact')} THEN 'redact' WHEN {has('allow with restrictions')} OR {has('restricted')} "
            f"THEN 'allow_with_restrictions' WHEN {has('allow')} AND NOT {has('disallow')} THEN 'allow' ELSE 'allow_with_restrictions' END")


def default_of(label: str, which: int) -> str:
    kind = ("INT", "DOUBLE")[which]
    return f"CASE {label} " + " ".join(f"WHEN {q(k)} THEN CAST({v[which]} AS {kind})" for k, v in C.GUARD_DEFAULTS.items()) + " END"


_fixed = {  # label, action, confidence, risk, reasons of the logged shapes
    0: ("prompt_injection", "deny", 0.91, 88, "override attempt"),
    1: ("benign", "allow", 0.8, 5, "llm_guard_label:benign,llm_guard_action:allow,llm_guard_parser:json"),
    2: ("jailbreak_attempt", "deny", 1.0, 100, "llm_guard_label:jailbreak_attempt,llm_guard_action:deny,llm_guard_parser:embedded_json"),
    3: ("prompt_injection", "deny", 0.8, 75, "llm_guard_label:prompt_injection,llm_guard_action:deny,llm_guard_parser:heuristic_non_json,guard_marked_unsafe"),
    4: ("benign", "allow", 0.7, 10, "llm_guard_label:benign,llm_guard_action:allow,llm_guard_parser:heuristic_non_json,guard_marked_safe"),
    5: ("secret_exfiltration_intent", "allow_with_restrictions", 0.5, 72, "asks for a password"),
    6: ("sensitive_data_submission", "redact", 0.0, 0, "one reason"),
    7: ("suspicious", "allow_with_restrictions", 0.5, 50, "llm_guard_label:suspicious,llm_guard_action:allow_with_restrictions,llm_guard_parser:json"),
}
_l, _a = infer_label("text"), infer_action("text")
_marks_sql = "CASE WHEN contains(lower(text), 'unsafe') THEN ',guard_marked_unsafe' WHEN contains(lower(text), 'safe') THEN ',guard_marked_safe' ELSE '' END"
SQL["normalize_guard"] = "SELECT conv_id * 1000000 + turn AS trace_id, " + ", ".join(
    f"CASE {_shape} " + " ".join(f"WHEN {k} THEN {render(v[i])}" for k, v in _fixed.items()) + f" ELSE {other} END AS {name}"
    for i, (name, render, other) in enumerate((
        ("guard_label", q, _l), ("guard_action", q, _a), ("guard_confidence", lambda v: f"CAST({v} AS DOUBLE)", default_of(_l, 1)),
        ("guard_risk", lambda v: f"CAST({v} AS INT)", default_of(_l, 0)),
        ("guard_reasons", q, f"'llm_guard_label:' || {_l} || ',llm_guard_action:' || {_a} || ',llm_guard_parser:heuristic_non_json' || {_marks_sql}")))) + " FROM conversations WHERE role = 'user'"
SQL["infer_guard_label"] = sql(f"""SELECT *, {default_of('label', 0)} AS risk_score, {default_of('label', 1)} AS confidence FROM (SELECT trace_id, {infer_label('raw_text')} AS label FROM fx_guard_raw
 UNION ALL SELECT -doc_id - 1, {infer_label('text')} FROM documents) x""", "fx_guard_raw")
SQL["infer_guard_action"] = sql(f"SELECT trace_id, {infer_action('raw_text')} AS action FROM fx_guard_raw", "fx_guard_raw")

# --- evaluation -----------------------------------------------------------

_pack = ", ".join(f"({i}, {q(p)}, {q(e)})" for i, (p, e) in enumerate(PAYLOADS))
CTE["packed"] = (("norm",), f"""SELECT *, lower(payload) AS plow FROM (SELECT content || ' ' || addition AS payload, expected_label FROM norm
 JOIN (VALUES {_pack}) p(n, addition, expected_label) ON p.n = (conv_id * 7 + turn * 11) % {len(PAYLOADS)}) x""")
SQL["regression_pack"] = sql("SELECT *, round(found / payloads, 6) AS recall FROM (SELECT expected_label, count(*) AS payloads, count(*) FILTER (WHERE CASE expected_label "
                             + " ".join(f"WHEN {q(n)} THEN {label_sql(n, 'payload', 'plow')} = 1" for n in C.INPUT_LABELS)
                             + f" END) AS found, count(*) FILTER (WHERE {points_sql(text='payload', low='plow')} > 0) AS scored FROM packed GROUP BY expected_label) r", "packed")
CTE["doc_scan"] = ((), f"SELECT doc_id, source, lang, {scan_columns('text', 'low')} FROM (SELECT doc_id, source, lang, text, lower(text) AS low FROM documents) d")
CTE["page_scan"] = ((), f"SELECT -page_id - 1 AS doc_id, 'page' AS source, 'html' AS lang, {scan_columns('html', 'low')} FROM (SELECT page_id, html, lower(html) AS low FROM pages) p")
SQL["detector_quality"] = sql("""SELECT *, round(tp / nullif(tp + fp, 0), 6) AS precision, round(tp / nullif(tp + fn, 0), 6) AS recall FROM (SELECT count(*) AS judged, count(*) FILTER (WHERE f AND t) AS tp, count(*) FILTER (WHERE f AND NOT t) AS fp,
 count(*) FILTER (WHERE NOT f AND t) AS fn, count(*) FILTER (WHERE NOT f AND NOT t) AS tn FROM (SELECT signal_count > 0 AS f, toxic = 1 AS t FROM doc_scan JOIN labels USING (doc_id)) x) c""", "doc_scan")
SQL["corpus_scan"] = sql(f"""SELECT source, lang, count(*) AS texts, count(*) FILTER (WHERE signal_count > 0) AS flagged, {big('sum(signal_count)')} AS signals, CAST(max(least(100, scan_points)) AS INT) AS max_score,
 CAST(grouping_id(source, lang) AS INT) AS level FROM (SELECT * FROM doc_scan UNION ALL SELECT * FROM page_scan) s GROUP BY ROLLUP (source, lang)""", "doc_scan", "page_scan")
SQL["corpus_riskiest"] = sql("SELECT doc_id, CAST(least(100, scan_points) AS INT) AS score, signal_count FROM doc_scan ORDER BY score DESC, signal_count DESC, doc_id LIMIT 20", "doc_scan")
