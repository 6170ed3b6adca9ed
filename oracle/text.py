"""Oracle SQL for sources, normalisation, threat scan, DLP and redaction."""

from __future__ import annotations

from guardlake import catalog as C
from oracle.base import (CTE, any_hit, big, count_of, csv_of, dlp_columns, counts_sql, hit, leaks_redacted, overlay,
                         pattern_flags, q, re2, rewrite, rewritten, sanitize, scan_columns, sql, strip)

SQL: dict[str, str] = {}

SQL["load_messages"] = """
SELECT conv_id * 1000000 + turn AS trace_id, 0 AS msg_index, role, text AS content FROM conversations
UNION ALL SELECT conv_id * 1000000 + turn, 1, 'developer', 'turn ' || turn FROM conversations"""

SQL["coerce_message_content"] = """
SELECT * FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 2 THEN 'user' ELSE role END AS role,
  CASE (conv_id + turn) % 5 WHEN 0 THEN regexp_replace(text, '[^A-Za-z ]', '', 'g')
    WHEN 1 THEN trim(regexp_replace(text, '[^A-Za-z ]', '', 'g') || chr(10) || ' b ')
    WHEN 2 THEN '42' ELSE '' END AS content FROM conversations) x WHERE trim(content) <> ''"""

SQL["policy_bundle"] = sql("""
SELECT rule_ord, rule_name, enabled, condition_count, action, reason_code, max_context_sensitivity, response_mode,
  (SELECT count(*) FROM ords o WHERE o.rule_ord = r.rule_ord) AS decided FROM rules r""", "ords", "rules")

_registry = ", ".join(f"({q(n)}, {q(p)}, {q(s)}, {str(e).upper()})" for n, p, s, e in C.TOOL_REGISTRY)
SQL["tool_registry"] = sql(f"""
SELECT t.*, (SELECT count(*) FROM fx_requests r WHERE r.tool_name = t.tool_name) AS requested_calls
FROM (VALUES {_registry}) t(tool_name, required_permission, tool_sensitivity, tool_enabled)""", "fx_requests")

_listed = [(f, name, test) for f in C.FAMILIES for name, test in pattern_flags(f)]
SQL["pattern_catalog"] = sql(
    "SELECT * FROM (" + " UNION ALL ".join(
        f"SELECT {q(f.key)} AS family, {q(f.category)} AS category, {q(f.severity)} AS severity, {f.weight} AS weight, {q(name)} AS pattern, "
        f"(SELECT count(*) FROM low WHERE {test}) AS messages_hit" for f, name, test in _listed) + ") x", "low")

SQL["load_chunks"] = sql("SELECT chunk_id, document_id, chunk_tenant, sensitivity, content_hash, len(chunk_text) AS chunk_chars FROM fx_chunks", "fx_chunks")

_audit = "SELECT event_id, us, session_id, subject, action AS event_type, reason_code, strftime(ts, '%Y-%m-%d') AS event_date FROM fx_log"
SQL["audit_sink"] = sql(f"SELECT event_date, event_type, count(*) AS events, min(event_id) AS first_event, {big('sum(session_id)')} AS sessions_sum FROM ({_audit}) a GROUP BY ALL", "fx_log")
SQL["audit_recent"] = sql(f"SELECT event_id, event_type, subject, us FROM ({_audit}) a ORDER BY us DESC, event_id DESC LIMIT 50", "fx_log")
SQL["latest_state"] = sql("""
SELECT tenant_id AS namespace, session_id AS key, arg_max(action, (us, event_id)) AS payload, max((us, event_id))[1] AS updated_at, max((us, event_id))[2] AS event_id
FROM fx_log GROUP BY ALL ORDER BY updated_at DESC, event_id DESC LIMIT 100""", "fx_log")
SQL["latest_state_delta"] = sql("""
SELECT tenant_id AS namespace, session_id AS key, arg_max(action, (us, event_id)) AS payload, max((us, event_id))[1] AS updated_at, max((us, event_id))[2] AS event_id
FROM fx_log GROUP BY ALL""", "fx_log")
SQL["audit_store_newest"] = SQL["audit_recent"]
SQL["audit_store_lookup"] = sql("""SELECT event_id, session_id, subject, action AS event_type, reason_code, us, strftime(ts, '%Y-%m-%d') AS event_date FROM fx_log
WHERE session_id IN (SELECT session_id FROM fx_log WHERE action = 'deny' AND input_score = 100)""", "fx_log")

# --- normalisation and validation -----------------------------------------

SQL["normalize_messages"] = sql("SELECT conv_id, turn, role, content, has_control_chars, len(content) AS content_length FROM norm", "norm")
SQL["trust_label"] = """SELECT role, CASE WHEN role IN ('system', 'developer') THEN 'trusted' WHEN role = 'assistant' THEN 'semi_trusted'
  ELSE 'untrusted' END AS source_label, count(*) AS messages FROM conversations GROUP BY ALL"""
_flag = lambda *cols: " OR ".join(f"coalesce({any_hit(f'lower({c})', C.ATTACHMENT_FLAGS)}, FALSE)" for c in cols)
SQL["request_facts"] = sql(f"""
SELECT m.*, coalesce(a.attachment_count, 0) AS attachment_count, coalesce(a.metadata_injection_count, 0) AS metadata_injection_count,
  coalesce(a.metadata_injection_count, 0) > 0 AS metadata_injection_detected
FROM (SELECT conv_id, count(*) AS message_count, bool_or(role = 'system') AS has_system_messages, bool_or(role = 'developer') AS has_developer_messages
      FROM fx_messages GROUP BY conv_id) m
LEFT JOIN (SELECT conv_id, count(*) AS attachment_count, count(*) FILTER (WHERE {_flag('name', 'content_type', 'uri')}) AS metadata_injection_count
      FROM fx_attachments GROUP BY conv_id) a USING (conv_id)""", "fx_messages", "fx_attachments")
SQL["attachment_metadata_flags"] = sql(f"""
SELECT trace_id, {_flag('name', 'content_type', 'uri')} AS flagged FROM fx_attachments
UNION ALL SELECT -page_id - 1, {_flag('url', 'html')} FROM pages""", "fx_attachments")
_odd = """SELECT conv_id, turn, CASE WHEN (conv_id * 3 + turn) % 7 = 1 THEN 'robot' ELSE role END AS role,
  CASE (conv_id * 3 + turn) % 7 WHEN 2 THEN '' WHEN 3 THEN repeat(content, 400) ELSE content END AS content FROM fx_messages"""
_verdict = f"""CASE WHEN role NOT IN {C.ROLES} THEN 'unknown_role' WHEN len(content) < {C.MIN_CONTENT} THEN 'content_too_short'
  WHEN len(content) > {C.MAX_CONTENT} THEN 'content_too_long' ELSE 'accepted' END"""
SQL["quarantine_invalid"] = sql(f"""
SELECT {_verdict} AS verdict, count(*) AS messages FROM ({_odd}) o GROUP BY ALL
UNION ALL SELECT 'in_valid_request', count(*) FROM (SELECT sum(CASE WHEN {_verdict} = 'accepted' THEN strlen(content) ELSE {C.MAX_REQUEST_BYTES + 1} END)
  OVER (PARTITION BY conv_id ORDER BY turn) AS upto FROM ({_odd}) o) w WHERE upto <= {C.MAX_REQUEST_BYTES}""", "fx_messages")
SQL["sanitize_text"] = sql(f"SELECT conv_id, turn, {sanitize('content')} AS sanitized FROM fx_messages", "fx_messages")
SQL["retrieval_query_text"] = sql(f"""
SELECT conv_id, turn, {strip("q")} AS query_text FROM (SELECT conv_id, turn, string_agg(content, chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS q
  FROM norm WHERE role = 'user') u""", "norm")
SQL["join_role_text"] = sql(f"""
SELECT conv_id, role, string_agg({sanitize('content')}, chr(10) || chr(10) ORDER BY turn) AS role_text, count(*) AS message_count
FROM within WHERE {strip('content')} <> '' GROUP BY conv_id, role""", "within")

# --- input threat scan ----------------------------------------------------


def _signals(families, source="low") -> str:
    return " UNION ALL ".join(
        f"SELECT conv_id, turn, {q(f.category)} AS category, {q(f.severity)} AS severity, {f.weight} AS weight, {q(name)} AS pattern, "
        f"left(content, {C.EVIDENCE_CHARS}) AS evidence FROM {source} WHERE {test}" for f in families for name, test in pattern_flags(f))


CTE["marked"] = (("low",), "SELECT conv_id, turn, content || CASE conv_id % 6 WHEN 0 THEN chr(8203) WHEN 1 THEN chr(1569) WHEN 2 THEN chr(8238) "
                 "WHEN 3 THEN 'e' || chr(769) ELSE '' END AS content, low FROM low")
for _f in C.FAMILIES:
    _from = "marked" if _f is C.UNICODE_TRICKS else "low"
    SQL[f"scan_{_f.key}"] = sql(_signals((_f,), _from), _from)
SQL["signals_long"] = sql(_signals(C.FAMILIES), "low")
SQL["input_scan_rollup"] = sql(f"""
SELECT conv_id, CAST(least(100, sum(scan_points)) AS INT) AS input_score, {csv_of(C.INPUT_LABELS, lambda n: f'max(is_{n})')} AS input_labels,
  {big('sum(signal_count)')} AS signal_count FROM (SELECT conv_id, {scan_columns()} FROM low) s GROUP BY conv_id""", "low")


def _needed(p: C.Pattern, f: C.Family) -> str:
    if not p.needs:
        return hit("low" if f.lowered else "content", p.text, f.ignore_case)
    fold = "translate(low, 'ſı', 'si')"
    return "(" + " AND ".join("(" + " OR ".join(f"contains({fold}, {q(s)})" for s in group) + ")" for group in p.needs) + ")"


SQL["signal_prefilter"] = sql(" UNION ALL ".join(
    f"SELECT {q(f.key)} AS family, count(*) FILTER (WHERE {' OR '.join(_needed(p, f) for p in f.patterns)}) AS may_hit, "
    f"count(*) FILTER (WHERE {' OR '.join(t for _, t in pattern_flags(f))}) AS hits, CAST(0 AS BIGINT) AS lost FROM low" for f in C.FAMILIES), "low")

# --- DLP and redaction ----------------------------------------------------


def _matches(source: str, keys: str, text: str, detectors=C.DETECTORS) -> str:
    return " UNION ALL ".join(
        f"SELECT {keys}, {q(d.category)} AS category, {q(d.severity)} AS severity, {q(d.name)} AS pattern_name, CAST(i - 1 AS INT) AS match_pos, m[i] AS matched FROM "
        f"(SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {keys}, regexp_extract_all({text}, {q(re2(d.text, True))}) AS m FROM {source}) a) b"
        for d in detectors)


def _placed(source: str, keys: str, text: str) -> str:
    """Matches with start offsets: gaps before plus matches before."""
    size = lambda xs: f"coalesce(list_sum(list_transform({xs}, lambda s: len(s))), 0)"
    return " UNION ALL ".join(
        f"SELECT {keys}, {q(d.category)} AS category, {q(d.severity)} AS severity, {q(d.name)} AS pattern_name, {k} AS detector_pos, CAST(i - 1 AS INT) AS match_pos, m[i] AS matched, "
        f"CAST({size('g[1:i]')} + {size('m[1:i-1]')} AS INT) AS match_start, {text} AS txt FROM "
        f"(SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT {keys}, {text}, regexp_extract_all({text}, {q(re2(d.text, True))}) AS m, "
        f"string_split_regex({text}, {q(re2(d.text, True))}) AS g FROM {source}) a) b" for k, d in enumerate(C.DETECTORS))


_preview = (f"left(replace(substring(txt, greatest(0, match_start - {C.PREVIEW_MARGIN}) + 1, match_start + len(matched) + {C.PREVIEW_MARGIN} "
            f"- greatest(0, match_start - {C.PREVIEW_MARGIN})), chr(10), ' '), {C.PREVIEW_CHARS})")

SQL["dlp_matches"] = sql(_matches("norm", "conv_id, turn", "content"), "norm")
SQL["dlp_evidence"] = sql(f"SELECT conv_id, turn, category, severity, pattern_name, match_pos, matched, match_start, {_preview} AS evidence_preview "
                          f"FROM ({_placed('norm', 'conv_id, turn', 'content')}) p", "norm")
SQL["dlp_metadata_injection"] = sql(_matches("att_n", "trace_id", "meta", C.METADATA_DETECTORS), "att_n")
SQL["dlp_attachment_content"] = sql(
    f"SELECT * EXCLUDE (matched), 'message' AS origin FROM ({_matches('norm', 'conv_id, turn', 'content')}) x UNION ALL "
    f"SELECT * EXCLUDE (matched), 'attachment' FROM ({_matches('fx_attachments', 'conv_id, turn', 'att_text')}) y", "norm", "fx_attachments")
SQL["dlp_rollup"] = sql(f"""
SELECT conv_id, CAST(least(100, sum(dlp_points)) AS INT) AS dlp_score, {csv_of(C.DLP_LABELS, lambda n: f'max(dlp_{n})')} AS dlp_labels,
  {big('sum(match_count)')} AS match_count, {big('sum(critical_count)')} AS critical_count, {big('sum(high_count)')} AS high_count
FROM (SELECT conv_id, {dlp_columns()} FROM (SELECT conv_id, {counts_sql()} FROM norm) c) s GROUP BY conv_id""", "norm")


def _counted_rewrites(source: str, keys: str, text: str) -> str:
    """One subquery per step, so that counts see the text of their own step."""
    inner = f"SELECT {keys}, {text} AS t, 0 AS n FROM {source}"
    for rule in C.PROMPT_REWRITES:
        counted = f"len(regexp_extract_all(t, {q(re2(rule.text, rule.ignore_case))}))"
        inner = f"SELECT {keys}, {rewrite('t', rule)} AS t, n + {counted} AS n FROM ({inner}) s"
    return inner


CTE["texts"] = (("norm",), "SELECT conv_id * 1000000 + turn AS id, content FROM norm UNION ALL SELECT -doc_id - 1, text FROM documents")
SQL["redact_pii"] = sql(f"SELECT id, t AS redacted, CAST(n AS INT) AS replacements FROM ({_counted_rewrites('texts', 'id', 'content')}) r", "texts")
SQL["redact_secrets_output"] = sql(f"SELECT trace_id, {rewritten('output_text', C.OUTPUT_REWRITES)} AS redacted FROM fx_responses", "fx_responses")
SQL["redact_prompt_leak"] = sql(f"SELECT trace_id, {leaks_redacted('output_text')} AS redacted FROM fx_responses", "fx_responses")


def residual_rows(source: str, keys: str, text: str) -> str:
    return f"SELECT * FROM ({_placed(source, keys, text)}) p WHERE category IN {C.SENSITIVE_CATEGORIES} AND NOT contains({_preview}, '[REDACTED_')"


CTE["half"] = (("norm",), f"SELECT conv_id, turn, {rewritten('content', C.OUTPUT_REWRITES)} AS content FROM norm")
SQL["residual_check"] = sql(f"""
SELECT conv_id, turn, {big('sum(n)')} AS residual_count, string_agg(pattern_name, ',' ORDER BY detector_pos) AS residual_patterns FROM
 (SELECT conv_id, turn, pattern_name, detector_pos, count(*) AS n FROM ({residual_rows('half', 'conv_id, turn', 'content')}) r GROUP BY ALL) g
GROUP BY conv_id, turn""", "half")


def failsafe_sql(source: str, keys: str, text: str, extra: str = "") -> str:
    """keys, text after the fail-safe, residual count, changed flag."""
    names = keys.split(", ")
    on = " AND ".join(f"a.{k} = b.{k}" for k in names)
    return (f"SELECT {', '.join('a.' + k for k in names)}, CASE WHEN b.n > 0 AND m.t <> a.{text} THEN m.t ELSE a.{text} END AS {text}, "
            f"CAST(coalesce(b.n, 0) AS INT) AS residual_count, coalesce(b.n > 0 AND m.t <> a.{text}, FALSE) AS was_redacted{extra} FROM {source} a "
            f"LEFT JOIN (SELECT {keys}, count(*) AS n FROM ({residual_rows(source, keys, text)}) r GROUP BY ALL) b ON {on} "
            f"LEFT JOIN (SELECT {keys}, {rewritten(text, C.PROMPT_REWRITES)} AS t FROM {source}) m ON " + on.replace("b.", "m."))


SQL["failsafe_redact"] = sql(failsafe_sql("norm", "conv_id, turn", "content"), "norm")
CTE["kinds"] = (("norm", "fx_attachments", "fx_chunks0"),
                "SELECT row_number() OVER () AS id, * FROM (SELECT 'message' AS kind, content FROM norm WHERE role <> 'system' UNION ALL "
                "SELECT 'attachment', att_text FROM fx_attachments UNION ALL SELECT 'chunk', chunk_text FROM fx_chunks0) k WHERE trim(content) <> ''")
SQL["redaction_counts"] = sql(f"SELECT kind, count(*) AS seen, count(*) FILTER (WHERE was_redacted) AS redacted FROM "
                              f"({failsafe_sql('kinds', 'id', 'content', ', a.kind')}) f GROUP BY kind", "kinds")
SQL["dlp_corpus_profile"] = "SELECT * FROM (" + " UNION ALL ".join(
    f"SELECT source, lang, {q(d.name)} AS detector, {big('sum(n)')} AS matches, count(*) AS documents FROM "
    f"(SELECT source, lang, {count_of('text', d.text)} AS n FROM documents) x WHERE n > 0 GROUP BY ALL" for d in C.DETECTORS) + ") y"
