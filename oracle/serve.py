"""Oracle SQL for retrieval, tools, prompts and answers."""

from __future__ import annotations

from guardlake import catalog as C
from oracle.base import (CTE, any_hit, big, counts_sql, csv_of, dlp_columns, hit, leaks_redacted, q, rank, re2, rewrite,
                         rewritten, sanitize, sql, strip, tokens)
from oracle.text import _counted_rewrites, residual_rows

SQL: dict[str, str] = {}

# --- retrieval ------------------------------------------------------------

CTE["top5"] = (("fx_candidates",), "SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY score DESC NULLS LAST, chunk_id) AS INT) AS rank FROM fx_candidates) t WHERE rank <= 5")
SQL["retrieve_topk"] = sql("SELECT trace_id, chunk_id, score, rank FROM top5", "top5")
SQL["retrieve_topk_cosine"] = sql("""
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY trace_id ORDER BY score DESC NULLS LAST, chunk_id) AS INT) AS rank FROM
 (SELECT c.trace_id, c.chunk_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS score FROM fx_candidates c
  JOIN fx_requests r USING (trace_id) LEFT JOIN embeddings a ON a.vec_id = r.conv_id LEFT JOIN embeddings b ON b.vec_id = c.chunk_id) s) t WHERE rank <= 5""", "fx_candidates", "fx_requests")
SQL["retrieve_index_exact"] = """
SELECT * FROM (SELECT query_id, id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM
 (SELECT q.vec_id AS query_id, v.vec_id AS id, round(list_cosine_similarity(CAST(q.embedding AS DOUBLE[]), CAST(v.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings q, embeddings v WHERE q.vec_id % 20 = 0)) WHERE rank <= 10"""
TENANT_OK = "(coalesce(tenant_id, '') = '' OR coalesce(chunk_tenant, '') = '' OR tenant_id = chunk_tenant)"
SENS_OK = f"({rank('sensitivity', C.SENSITIVITY_RANK)} <= {rank('coalesce(max_context_sensitivity, ' + q('internal') + ')', C.SENSITIVITY_RANK)})"
CTE["chk"] = (("fx_chunks",), f"SELECT *, content_hash = sha256(chunk_text) AS integrity_ok, NOT {any_hit('lower(chunk_text)', C.CHUNK_INJECTION)} AS injection_ok FROM fx_chunks")
CTE["cand"] = (("top5", "fx_requests", "chk"), "SELECT t.*, r.tenant_id, c.* EXCLUDE (chunk_id) FROM top5 t JOIN fx_requests r USING (trace_id) JOIN chk c USING (chunk_id)")
SQL["tenant_filter"] = sql(f"SELECT trace_id, chunk_id, tenant_id, chunk_tenant, {TENANT_OK} AS tenant_ok FROM cand", "cand")
SQL["sensitivity_filter"] = sql(f"SELECT c.trace_id, chunk_id, sensitivity, max_context_sensitivity, {SENS_OK} AS sensitivity_ok FROM cand c LEFT JOIN dec USING (trace_id)", "cand", "dec")
SQL["integrity_hash"] = sql("SELECT chunk_id, integrity_ok AS hash_ok FROM chk", "chk")
SQL["integrity_hmac"] = "SELECT doc_id AS chunk_id, doc_id % 3 <> 1 AS hmac_ok FROM documents"
SQL["indirect_injection_filter"] = sql("SELECT chunk_id, len(chunk_text) AS chunk_chars FROM chk WHERE injection_ok", "chk")
SQL["retrieval_gate"] = sql("""SELECT r.trace_id, d.allow_retrieval, coalesce(d.allow_retrieval, FALSE) AS retrieval_open FROM fx_requests r
 LEFT JOIN (SELECT * FROM dec WHERE trace_id % 10 <> 4) d USING (trace_id)""", "fx_requests", "dec")
CTE["pairs"] = (("top5", "chk", "dec"), f"""SELECT *, CASE WHEN integrity_ok IS NULL THEN 'missing' WHEN NOT {TENANT_OK} THEN 'tenant' WHEN NOT {SENS_OK} THEN 'sensitivity' WHEN NOT integrity_ok THEN 'integrity'
  WHEN NOT injection_ok THEN 'injection' END AS drop_reason FROM (SELECT t.*, c.* EXCLUDE (chunk_id), d.tenant_id, d.max_context_sensitivity FROM top5 t LEFT JOIN chk c USING (chunk_id)
  JOIN dec d USING (trace_id) WHERE d.allow_retrieval) p""")
SQL["retrieval_funnel"] = sql("""SELECT d.trace_id, count(*) FILTER (WHERE drop_reason IN ('tenant', 'sensitivity')) AS filtered_out_count,
 count(*) FILTER (WHERE drop_reason = 'missing') AS missing_count, count(*) FILTER (WHERE drop_reason = 'integrity') AS integrity_filtered_count, count(*) FILTER (WHERE drop_reason = 'injection') AS injection_filtered_count,
 count(*) FILTER (WHERE p.chunk_id IS NOT NULL AND drop_reason IS NULL) AS allowed_count FROM dec d LEFT JOIN pairs p USING (trace_id) GROUP BY d.trace_id""", "dec", "pairs")


def _rollup(source: str, key: str) -> str:
    return (f"SELECT {key}, CAST(least(100, sum(dlp_points)) AS INT) AS dlp_score, {csv_of(C.DLP_LABELS, lambda n: f'max(dlp_{n})')} AS dlp_labels, "
            f"{big('sum(match_count)')} AS match_count, {big('sum(critical_count)')} AS critical_count, {big('sum(high_count)')} AS high_count FROM {source} GROUP BY {key}")


CTE["chunk_n"] = (("fx_chunks",), f"SELECT chunk_id, {dlp_columns()} FROM (SELECT chunk_id, {counts_sql('chunk_text')} FROM fx_chunks) c")
SQL["chunk_dlp"] = sql(_rollup("(SELECT t.trace_id, n.* FROM pairs t JOIN chunk_n n USING (chunk_id) WHERE t.drop_reason IS NULL) s", "trace_id"), "pairs", "chunk_n")

# --- tools ----------------------------------------------------------------

CTE["calls"] = (("fx_requests",), """SELECT trace_id, session_id, CAST(0 AS INT) AS call_pos, coalesce(tool_name, 'unknown') AS tool_name, tool_query AS argument FROM fx_requests
 UNION ALL SELECT trace_id, session_id, 1, coalesce(tool_name, 'unknown'), ' plain ' FROM fx_requests WHERE trace_id % 3 = 0""")
_inj, _chain = any_hit("lower(argument)", C.TOOL_ARG_INJECTION), any_hit("lower(argument)", C.TOOL_ARG_CHAIN)
_reg = ", ".join(f"({q(n)}, {q(p)}, {q(s)})" for n, p, s, _ in C.TOOL_REGISTRY)
SQL["tool_calls"] = sql("SELECT * FROM calls", "calls")
SQL["arg_injection"] = sql(f"SELECT trace_id, call_pos, {_inj} AS arg_injection FROM calls", "calls")
SQL["arg_tool_chain"] = sql(f"SELECT trace_id, call_pos, {_chain} AS arg_chain FROM calls", "calls")
SQL["sanitize_args"] = sql("SELECT trace_id, left(trim(repeat(tool_query, 100)), 1000) AS argument FROM fx_requests", "fx_requests")


def _authorized(context: str) -> str:
    return (f"SELECT *, decision = 'TOOL_ALLOWED' AS allowed, CASE WHEN decision = 'TOOL_ALLOWED' THEN left({strip('argument')}, 1000) END AS clean FROM (SELECT c.*, CASE "
            "WHEN g.permission IS NULL THEN 'UNKNOWN_TOOL' WHEN d.disable_tools THEN 'TOOLS_DISABLED_BY_POLICY' "
            "WHEN NOT list_contains(string_split(d.permissions_csv, ','), g.permission) THEN 'MISSING_TOOL_PERMISSION' "
            f"WHEN {rank('g.sensitivity', C.SENSITIVITY_RANK)} > {rank('d.max_context_sensitivity', C.SENSITIVITY_RANK)} THEN 'TOOL_SENSITIVITY_EXCEEDS_POLICY' "
            f"WHEN d.label IN {C.HARD_ATTACK_LABELS} THEN 'TOOL_BLOCKED_BY_CONTENT_CLASSIFICATION' WHEN {_inj} THEN 'TOOL_ARGUMENT_INJECTION_DETECTED' "
            f"WHEN {_chain} THEN 'TOOL_CHAIN_INJECTION_DETECTED' ELSE 'TOOL_ALLOWED' END AS decision FROM calls c JOIN ({context}) d USING (trace_id) "
            f"LEFT JOIN (VALUES {_reg}) g(tool_name, permission, sensitivity) USING (tool_name)) a")


_eased = ("SELECT trace_id, permissions_csv, disable_tools AND trace_id % 2 = 0 AS disable_tools, CASE WHEN trace_id % 2 = 0 THEN max_context_sensitivity ELSE 'restricted' END AS max_context_sensitivity, "
          "CASE WHEN trace_id % 4 = 1 THEN 'benign' ELSE label END AS label FROM dec")
CTE["auth"] = (("calls", "dec"), _authorized(_eased))
CTE["auth_real"] = (("calls", "dec"), _authorized("SELECT trace_id, permissions_csv, disable_tools, max_context_sensitivity, label FROM dec"))
SQL["tool_decision"] = sql("SELECT trace_id, call_pos, tool_name, decision, allowed, clean AS argument FROM auth", "auth")
_rendered = """lower('{"query":"' || clean || '"}')"""
CTE["records"] = (("auth",), f"""SELECT trace_id, session_id, call_pos, tool_name, record_reason, record_reason = 'TOOL_EXECUTION_STUB' AS executed,
 CASE WHEN record_reason = 'TOOL_EXECUTION_STUB' THEN clean END AS argument FROM (SELECT a.trace_id, a.session_id, a.call_pos, a.tool_name, l.clean,
  CASE WHEN NOT l.allowed THEN l.decision WHEN {any_hit(_rendered.replace('clean', 'l.clean'), C.TOOL_OUTPUT_CHAIN)} THEN 'TOOL_CHAIN_INJECTION_OUTPUT_DETECTED' ELSE 'TOOL_EXECUTION_STUB' END AS record_reason
  FROM auth a JOIN (SELECT * FROM auth QUALIFY row_number() OVER (PARTITION BY trace_id, tool_name ORDER BY call_pos DESC) = 1) l USING (trace_id, tool_name)) r""")
SQL["tool_execution_records"] = sql("SELECT trace_id, call_pos, tool_name, record_reason, executed, argument FROM records", "records")
SQL["tool_usage"] = sql("SELECT session_id, count(*) FILTER (WHERE used) AS tool_request_count, count(*) AS requests FROM (SELECT session_id, trace_id, bool_or(executed) AS used FROM records JOIN dec USING (trace_id, session_id) WHERE action NOT IN ('deny', 'challenge') GROUP BY session_id, trace_id) u GROUP BY session_id", "records", "dec")

# --- prompts --------------------------------------------------------------

_bul = lambda lines: "\n".join(f"- {line}" for line in lines)
_guarded = C.POLICY_LINES + C.GUARDED_LINES
CTE["hist"] = (("within",), f"""SELECT conv_id, turn, role,
 string_agg(CASE WHEN role = 'user' AND {strip('content')} <> '' THEN {sanitize('content')} END, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS user_input,
 string_agg(CASE WHEN role = 'assistant' AND {strip('content')} <> '' THEN {sanitize('content')} END, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS assistant_history
 FROM within""")
CTE["rblock"] = (("pairs",), f"""SELECT trace_id, {strip("string_agg('[chunk_id=' || chunk_id || ' doc_id=' || document_id || ' sensitivity=' || sensitivity || ' trust=semi_trusted score=' || score || ']' || chr(10) || " + sanitize('chunk_text') + " || chr(10), chr(10) ORDER BY rank)")} AS retrieval_block
 FROM pairs WHERE drop_reason IS NULL GROUP BY trace_id""")
CTE["ablock"] = (("fx_attachments",), """SELECT trace_id, string_agg('- name=' || coalesce(name, 'None') || ', content_type=' || coalesce(content_type, 'None') || ', size_bytes=' || size_bytes || ', source=' || source || ', trust=' || source_label, chr(10) ORDER BY att_pos) AS attachment_block
 FROM fx_attachments GROUP BY trace_id""")
CTE["inputs"] = (("dec", "hist", "rblock", "ablock"), """SELECT d.trace_id, d.response_mode, coalesce(h.user_input, '') AS user_input, coalesce(h.assistant_history, '') AS assistant_history,
 coalesce(r.retrieval_block, '') AS retrieval_block, coalesce(a.attachment_block, '') AS attachment_block FROM dec d JOIN hist h ON h.conv_id = d.conv_id AND h.turn = d.turn
 LEFT JOIN rblock r USING (trace_id) LEFT JOIN ablock a USING (trace_id) WHERE d.action NOT IN ('deny', 'challenge')""")
_texts = (
    (f"CASE response_mode WHEN 'restricted' THEN {q(_bul(_guarded + C.RESTRICTED_LINES))} WHEN 'guarded' THEN {q(_bul(_guarded))} ELSE {q(_bul(C.POLICY_LINES))} END", "TRUE"),
    (f"CASE response_mode WHEN 'restricted' THEN {q(C.TASK_TEXT['restricted'])} WHEN 'guarded' THEN {q(C.TASK_TEXT['guarded'])} ELSE {q(C.TASK_TEXT['normal'])} END", "TRUE"),
    ("retrieval_block", "retrieval_block <> ''"),
    ("assistant_history", "assistant_history <> '' AND response_mode <> 'restricted'"),
    ("user_input", "user_input <> ''"),
    ("attachment_block", "attachment_block <> ''"),
)
CTE["sect"] = (("inputs",), "SELECT * EXCLUDE (o), CAST(row_number() OVER (PARTITION BY trace_id ORDER BY o) - 1 AS INT) AS section_pos FROM (" + " UNION ALL ".join(
    f"SELECT trace_id, response_mode, {i} AS o, {q(name)} AS section_name, {q(trust)} AS trust_level, {text} AS section_text FROM inputs WHERE {test}"
    for i, ((name, trust), (text, test)) in enumerate(zip(C.SECTIONS, _texts))) + ") s")
CTE["prompts"] = (("sect",), f"""SELECT trace_id, any_value(response_mode) AS response_mode, count(*) AS section_count,
 {strip("string_agg('[' || section_name || ']' || chr(10) || section_text || chr(10) || '[/' || section_name || ']' || chr(10), chr(10) ORDER BY section_pos)")} AS prompt_text FROM sect GROUP BY trace_id""")
SQL["prompt_sections"] = sql("SELECT trace_id, section_pos, section_name, trust_level, md5(section_text) AS text_md5, len(section_text) AS text_chars FROM sect", "sect")
SQL["prompt_render"] = sql("SELECT trace_id, section_count, md5(prompt_text) AS prompt_md5 FROM prompts", "prompts")
SQL["token_estimate"] = sql(f"SELECT trace_id, len(prompt_text) AS prompt_chars, {tokens('prompt_text')} AS token_estimate, len(prompt_text) > {C.MAX_PROMPT_CHARS} AS token_budget_exceeded FROM prompts", "prompts")
_trust = rank("trust_level", C.TRUST_RANK)
SQL["budget_truncate"] = sql(f"""SELECT trace_id, section_name, {big('suffix')} AS suffix_chars, suffix <= 1200 AS kept FROM (SELECT *, sum(2 * len(section_name) + len(section_text) + 9)
 OVER (PARTITION BY trace_id ORDER BY {_trust} DESC, section_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 AS suffix FROM sect) s""", "sect")
CTE["short"] = (("sect",), f"""SELECT trace_id, {strip("string_agg('[' || section_name || ']' || chr(10) || section_text || chr(10) || '[/' || section_name || ']' || chr(10), chr(10) ORDER BY t, section_pos)")} AS kept_text
 FROM (SELECT *, {_trust} AS t, sum(2 * len(section_name) + len(section_text) + 9) OVER (PARTITION BY trace_id ORDER BY {_trust} DESC, section_pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) - 2 AS suffix FROM sect) s
 WHERE suffix <= 1200 GROUP BY trace_id""")
SQL["budget_outcome"] = sql("""SELECT trace_id, len(prompt_text) AS prompt_chars, over AS token_budget_exceeded, CASE WHEN cut THEN 'truncate' ELSE 'ok' END AS budget_outcome,
 CASE WHEN cut THEN kept_text IS NULL END AS forced_slice, CASE WHEN cut THEN md5(coalesce(kept_text, left(prompt_text, 1200))) END AS truncated_md5,
 CASE WHEN cut THEN len(coalesce(kept_text, left(prompt_text, 1200))) END AS truncated_chars
 FROM (SELECT *, len(prompt_text) > 1200 AS over, len(prompt_text) > 1200 AND trace_id % 2 = 0 AS cut FROM prompts LEFT JOIN short USING (trace_id)) p""", "prompts", "short")
_side = lambda trusted, p: f"bool_or(trust_level {'=' if trusted else '<>'} 'trusted' AND {hit('section_text', p, True)})"
SQL["prompt_integrity"] = sql(
    f"SELECT trace_id, 'trust_level_ordering' AS kind, '' AS rule, section_name AS \"where\" FROM (SELECT *, {_trust} AS t, lag({_trust}) OVER (PARTITION BY trace_id ORDER BY section_pos) AS b FROM sect) o WHERE t < b"
    + "".join(f" UNION ALL SELECT trace_id, 'sensitive_keyword_in_trusted', {q(p)}, section_name FROM sect WHERE trust_level = 'trusted' AND {hit('section_text', p, True)}" for p in C.TRUSTED_KEYWORDS)
    + "".join(f" UNION ALL SELECT trace_id, 'contradiction_detected', {q(a)}, '' FROM (SELECT trace_id, {_side(True, a)} AS t, {_side(False, b)} AS u FROM sect GROUP BY trace_id) c{i} WHERE t AND u"
              for i, (a, b) in enumerate(C.CONTRADICTIONS)), "sect")
SQL["prompt_redact_mode"] = sql(f"SELECT trace_id, section_name, CAST(n AS INT) AS replacements, md5(t) AS text_md5 FROM ({_counted_rewrites('sect', 'trace_id, section_name', 'section_text')}) r", "sect")
CTE["prompt_left"] = (("prompts",), f"SELECT trace_id, count(*) AS n FROM ({residual_rows('prompts', 'trace_id', 'prompt_text')}) r GROUP BY trace_id")
SQL["hybrid_pii_check"] = sql("""SELECT p.trace_id, CAST(coalesce(l.n, 0) AS INT) AS residual_count, coalesce(l.n, 0) = 0 AS hybrid_pii_check_passed,
 coalesce(g.guard_label IN ('sensitive_data_submission', 'secret_exfiltration_intent'), FALSE) AS llm_pii_signal_detected
 FROM prompts p LEFT JOIN prompt_left l USING (trace_id) LEFT JOIN fx_guard g USING (trace_id)""", "prompts", "prompt_left", "fx_guard")
SQL["usage_tokens"] = sql(f"""SELECT tenant_id, model, count(*) AS requests, {big('sum(p)')} AS prompt_tokens, {big('sum(c)')} AS completion_tokens, {big('sum(p + c)')} AS total_tokens,
 CAST(grouping_id(tenant_id, model) AS INT) AS level FROM (SELECT q.tenant_id, g.model, {tokens('m.content')} AS p, CASE WHEN coalesce(a.output_text, '') = '' THEN 0 ELSE {tokens('a.output_text')} END AS c
 FROM fx_requests q JOIN fx_messages m ON m.role = 'user' AND m.conv_id = q.conv_id AND m.turn = q.turn JOIN fx_guard g USING (trace_id) LEFT JOIN fx_responses a USING (trace_id)) u GROUP BY ROLLUP (tenant_id, model)""",
 "fx_responses", "fx_messages", "fx_requests", "fx_guard")

# --- answers --------------------------------------------------------------

SQL["response_text"] = sql("SELECT trace_id, CASE field WHEN 'other' THEN 'guarded_output' ELSE field END AS found_field, CASE WHEN field <> 'other' THEN output_text END AS text FROM fx_responses", "fx_responses")
CTE["resp_n"] = (("fx_responses",), f"SELECT trace_id, output_text, {dlp_columns()} FROM (SELECT trace_id, output_text, {counts_sql('output_text')} FROM fx_responses) c")
SQL["output_dlp"] = sql(_rollup("resp_n", "trace_id"), "resp_n")
LEAKS = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {hit('lower(output_text)', p)} THEN {q(p)} END" for p in C.OUTPUT_LEAK_PHRASES) + "], lambda x: x IS NOT NULL), ',')"
SQL["leak_signals"] = sql(f"SELECT trace_id, {LEAKS} AS leaks FROM fx_responses", "fx_responses")
ANOMALY = ("CASE WHEN prompt_chars > 0 AND len(output_text) > prompt_chars * 3 THEN 'response_length_anomaly' "
           "WHEN prompt_chars < 500 AND len(output_text) > 5000 THEN 'high_output_without_high_input' END")


def _inspected(source: str) -> str:
    code = (f"CASE WHEN {ANOMALY} IS NOT NULL THEN 'OUTPUT_EXTRAPOLATION_DETECTED' WHEN guard_action = 'block' AND guard_confidence >= 0.95 AND guard_risk >= 85 THEN 'LLM_OUTPUT_GUARD_BLOCK' "
            f"WHEN guard_action IN ('redact', 'deny') OR guard_risk >= 70 THEN 'LLM_OUTPUT_GUARD_REDACT' WHEN dlp_score >= 50 THEN 'OUTPUT_DLP_HIGH_RISK' "
            f"WHEN {LEAKS} <> '' THEN 'OUTPUT_PROMPT_OR_POLICY_LEAKAGE' ELSE 'OUTPUT_ALLOWED' END")
    return (f"SELECT *, CASE WHEN output_action = 'block' THEN NULL WHEN output_action = 'allow' THEN output_text WHEN output_code = 'OUTPUT_EXTRAPOLATION_DETECTED' THEN "
            f"CASE WHEN len(output_text) > 500 THEN left(output_text, 500) || '...' ELSE output_text END WHEN output_code = 'LLM_OUTPUT_GUARD_REDACT' THEN {leaks_redacted(rewritten('output_text', C.OUTPUT_REWRITES))} "
            f"WHEN output_code = 'OUTPUT_DLP_HIGH_RISK' THEN {rewritten('output_text', C.OUTPUT_REWRITES)} ELSE {leaks_redacted('output_text')} END AS redacted_text FROM "
            f"(SELECT *, CASE WHEN output_code = 'LLM_OUTPUT_GUARD_BLOCK' OR (output_code = 'OUTPUT_PROMPT_OR_POLICY_LEAKAGE' AND response_mode = 'restricted') THEN 'block' "
            f"WHEN output_code = 'OUTPUT_ALLOWED' THEN 'allow' ELSE 'redact' END AS output_action FROM (SELECT *, {code} AS output_code FROM "
            f"(SELECT a.*, CAST(least(100, n.dlp_points) AS INT) AS dlp_score, g.guard_action, g.guard_confidence, g.guard_risk, g.guard_label FROM {source} a JOIN resp_n n USING (trace_id) LEFT JOIN fx_guard g USING (trace_id)) i) j) k")


CTE["passed"] = (("fx_responses", "prompts"), "SELECT a.trace_id, a.output_text, a.field, p.response_mode, len(p.prompt_text) AS prompt_chars FROM fx_responses a JOIN prompts p USING (trace_id)")
CTE["insp_real"] = (("passed", "resp_n", "fx_guard"), _inspected("passed"))
SQL["length_anomaly"] = sql(f"SELECT trace_id, prompt_chars, len(output_text) AS output_chars, {ANOMALY} AS anomaly FROM passed", "passed")
SQL["output_action"] = sql(f"""SELECT trace_id, output_action, output_code || CASE WHEN starts_with(output_code, 'LLM_') AND guard_label IS NOT NULL THEN ',model_verdict' ELSE '' END AS output_reasons,
 concat_ws(',', nullif({LEAKS}, ''), {ANOMALY}) AS output_signals, dlp_score, redacted_text FROM insp_real""", "insp_real")
SQL["apply_output"] = sql("""SELECT trace_id, output_action, CASE field WHEN 'other' THEN 'guarded_output' ELSE field END AS placed_in,
 CASE output_action WHEN 'redact' THEN redacted_text WHEN 'block' THEN NULL ELSE output_text END AS client_text FROM insp_real""", "insp_real")
_joined = f"{strip('t')}"
SQL["guard_input_text"] = sql(f"""SELECT trace_id, CASE WHEN len(t) > 500 THEN left(t, 500) || chr(10) || '[TRUNCATED_FOR_GUARD]' ELSE t END AS short,
 CASE WHEN len(t) > 8000 THEN left(t, 8000) || chr(10) || '[TRUNCATED_FOR_GUARD]' ELSE t END AS guard_text FROM (SELECT conv_id * 1000000 + turn AS trace_id, role, {strip('t')} AS t FROM
 (SELECT *, string_agg(CASE WHEN role = 'user' THEN content END, chr(10) || chr(10)) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS t FROM within) w) x WHERE role = 'user' AND t <> ''""", "within")

# --- one wide row per request ---------------------------------------------

_code = lambda *words: "(" + " OR ".join(f"contains(reason_code, {q(w)})" for w in words) + ")"
_before = lambda keys, test: f"coalesce(sum(CASE WHEN action = 'deny' AND {test} THEN 1 ELSE 0 END) OVER (PARTITION BY {keys} ORDER BY ts_s, trace_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
_profile = "client_id, subject"
CTE["rate"] = (("dec",), f"""SELECT trace_id, injections < 3 AND hits < CASE WHEN injections = 2 THEN greatest(1, by_profile // 2) ELSE by_profile END AS rate_allowed FROM
 (SELECT *, CASE WHEN m > 1 THEN greatest(1, by_score // m) ELSE by_score END AS by_profile FROM (SELECT *, least(20, (CASE WHEN jb >= 3 THEN 5 ELSE 1 END) * (CASE WHEN esc >= 2 THEN 3 ELSE 1 END) * (CASE WHEN inj >= 5 THEN 2 ELSE 1 END)) AS m,
  CASE WHEN input_score >= 80 THEN 3 WHEN input_score >= 50 THEN 6 WHEN input_score >= 30 THEN 15 ELSE 30 END AS by_score FROM (SELECT trace_id, input_score, {_before('session_id', 'TRUE')} AS injections,
   {_before(_profile, _code('INJECTION', 'JAILBREAK'))} AS inj, {_before(_profile, _code('JAILBREAK'))} AS jb, {_before(_profile, _code('ESCALATION', 'PRIVILEGE'))} AS esc,
   count(*) OVER (PARTITION BY client_id, subject ORDER BY ts_s RANGE BETWEEN 60 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY client_id, subject, ts_s ORDER BY trace_id DESC ROWS UNBOUNDED PRECEDING) AS hits FROM dec) a) b) c""")
CTE["blocked"] = (("auth_real", "dec"), """SELECT trace_id, count(*) AS requested_tool_count, coalesce(array_to_string(list_sort(list_distinct(list(tool_name || ':' || decision) FILTER (WHERE NOT allowed AND action NOT IN ('deny', 'challenge')))), ','), '') AS blocked_tools
 FROM auth_real JOIN (SELECT trace_id, action FROM dec) d USING (trace_id) GROUP BY trace_id""")
CTE["served"] = (("dec", "rate", "blocked", "prompts", "prompt_left", "insp_real"), f"""SELECT *, CASE outcome WHEN 'rate_limited' THEN 429 WHEN 'denied' THEN 403 WHEN 'challenge' THEN 403 WHEN 'budget_exceeded' THEN 413
  WHEN 'blocked_output' THEN 502 ELSE 200 END AS status_code FROM (SELECT *, CASE WHEN NOT rate_allowed THEN 'rate_limited' WHEN action = 'deny' THEN 'denied' WHEN action = 'challenge' THEN 'challenge'
  WHEN budget_outcome = 'block' THEN 'budget_exceeded' WHEN output_action = 'block' THEN 'blocked_output' ELSE 'ok' END AS outcome FROM
 (SELECT d.*, r.rate_allowed, b.requested_tool_count, b.blocked_tools, coalesce(l.n, 0) AS residual_count, CASE WHEN len(p.prompt_text) > {C.MAX_PROMPT_CHARS} THEN 'block' ELSE 'ok' END AS budget_outcome, i.output_action
  FROM dec d JOIN rate r USING (trace_id) LEFT JOIN blocked b USING (trace_id) LEFT JOIN prompts p USING (trace_id) LEFT JOIN prompt_left l USING (trace_id) LEFT JOIN insp_real i USING (trace_id)) w) s""")
SQL["decision_log"] = sql("""
SELECT trace_id, session_id, subject, tenant_id, message_count, attachment_count, requested_tool_count, allow_retrieval AS retrieval_allowed,
  risk_state, input_score, dlp_score, label, action, reason_code, outcome, output_action, guard_label, guard_risk, allowed_chunks, dropped_chunks, tool_decisions, output_reasons, output_signals
FROM served LEFT JOIN (SELECT trace_id, guard_label, guard_risk FROM fx_guard) g USING (trace_id)
 LEFT JOIN (SELECT trace_id, count(*) FILTER (WHERE drop_reason IS NULL) AS allowed_chunks, count(drop_reason) AS dropped_chunks FROM pairs GROUP BY trace_id) p USING (trace_id)
 LEFT JOIN (SELECT trace_id, string_agg(tool_name || ':' || decision, ',' ORDER BY call_pos) AS tool_decisions FROM auth_real JOIN (SELECT trace_id, action FROM dec) d USING (trace_id)
  WHERE action NOT IN ('deny', 'challenge') GROUP BY trace_id) t USING (trace_id)
 LEFT JOIN (SELECT trace_id, output_code || CASE WHEN starts_with(output_code, 'LLM_') AND guard_label IS NOT NULL THEN ',model_verdict' ELSE '' END AS output_reasons,
  concat_ws(',', nullif(""" + LEAKS + """, ''), """ + ANOMALY + """) AS output_signals FROM insp_real) o USING (trace_id)
WHERE outcome NOT IN ('rate_limited', 'budget_exceeded')""", "served", "fx_guard", "pairs", "auth_real", "insp_real")
