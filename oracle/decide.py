"""Oracle SQL for sessions, limits, classification and policy."""

from __future__ import annotations

from guardlake import catalog as C
from guardlake.sources.bundle import shipped
from oracle.base import CTE, big, class_case, condition_sql, decided_sql, has, q, rank, risk_select, rule_sql, sql

SQL: dict[str, str] = {}

BEFORE = "OVER (PARTITION BY session_id ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
COUNT = lambda test: big(f"coalesce(sum(CASE WHEN {test} THEN 1 ELSE 0 END) {BEFORE}, 0)")

SQL["session_rollup"] = sql(f"""
SELECT session_id, min(us) AS first_us, max(us) AS last_us, count(*) AS request_count, {big('sum(message_count)')} AS total_message_count,
  {big('sum(attachment_count)')} AS total_attachment_count, count(*) FILTER (WHERE action = 'deny') AS refusal_count,
  count(*) FILTER (WHERE tool_used) AS tool_request_count FROM fx_log GROUP BY session_id""", "fx_log")
CTE["seen0"] = (("fx_log",), f"SELECT *, {COUNT('TRUE')} + 1 AS request_count, {COUNT('action = ' + q('deny'))} AS refusal_count, "
                f"{COUNT('tool_used')} AS tool_request_count FROM fx_log")
CTE["seen"] = (("seen0",), f"SELECT *, {COUNT('action = ' + q('deny') + ' AND injection_attempt_count + 1 >= 2 AND input_score >= 60')} AS escalation_pattern_count "
               f"FROM (SELECT *, refusal_count AS injection_attempt_count FROM seen0) s")
SQL["session_running"] = sql("SELECT event_id, session_id, request_count, refusal_count, tool_request_count FROM seen0", "seen0")
SQL["injection_attempts"] = sql("SELECT event_id, session_id, injection_attempt_count, escalation_pattern_count FROM seen", "seen")
CTE["risk_in"] = (("seen",), "SELECT *, event_id % 11 = 0 AS has_control_chars, event_id % 13 = 0 AS has_system_messages, event_id % 17 = 0 AS has_developer_messages FROM seen")
CTE["log_risk"] = (("risk_in",), risk_select("risk_in"))
SQL["session_risk"] = sql("SELECT event_id, risk_score, risk_state, risk_reasons FROM log_risk", "log_risk")
SQL["risk_history"] = sql("""
SELECT session_id, count(*) AS history_length, max(risk_score) AS peak_score, arg_max(risk_score, (us, event_id)) AS last_score,
  arg_max(risk_state, (us, event_id)) AS last_state, count(*) FILTER (WHERE prev IS NULL OR prev <> risk_state) AS state_changes
FROM (SELECT *, lag(risk_state) OVER (PARTITION BY session_id ORDER BY us, event_id) AS prev FROM log_risk) r GROUP BY session_id""", "log_risk")
SQL["session_gap_windows"] = """
WITH g AS (SELECT user_id, ts, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts) + INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events),
 s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM g)
SELECT user_id, CAST(floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS start_s, CAST(floor(epoch_us(max(ts) + INTERVAL 30 MINUTE) / 1000000) AS BIGINT) AS end_s,
  count(*) AS events FROM s GROUP BY user_id, sid"""

# --- limits and profiles --------------------------------------------------

_hits = lambda s, name: (f"count(*) OVER (PARTITION BY client_id, subject ORDER BY us RANGE BETWEEN {s * 1000000} PRECEDING AND CURRENT ROW) - "
                         f"count(*) OVER (PARTITION BY client_id, subject, us ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS {name}")
SQL["sliding_hits"] = sql(f"SELECT event_id, client_id, subject, {_hits(60, 'current_hits')}, {_hits(3600, 'hits_hour')} FROM fx_log", "fx_log")
_pbefore = "OVER (PARTITION BY client_id, subject ORDER BY us, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
_code = lambda *words: "(" + " OR ".join(f"contains(reason_code, {q(w)})" for w in words) + ")"
_pcount = lambda *words: big(f"coalesce(sum(CASE WHEN action = 'deny' AND {_code(*words)} THEN 1 ELSE 0 END) {_pbefore}, 0)")
MULTIPLIER = ("least(20, (CASE WHEN jailbreak_attempts >= 3 THEN 5 ELSE 1 END) * (CASE WHEN escalation_attempts >= 2 THEN 3 ELSE 1 END) "
              "* (CASE WHEN injection_attempts >= 5 THEN 2 ELSE 1 END))")
CTE["prior"] = (("fx_log",), f"SELECT *, {big('coalesce(sum(CASE WHEN action = ' + q('deny') + ' THEN 1 ELSE 0 END) ' + BEFORE + ', 0)')} AS injections_before, "
                f"{_pcount('INJECTION', 'JAILBREAK')} AS injection_attempts, {_pcount('JAILBREAK')} AS jailbreak_attempts, "
                f"{_pcount('ESCALATION', 'PRIVILEGE')} AS escalation_attempts, {_hits(60, 'current_hits')} FROM fx_log")
CTE["limited"] = (("prior",), "SELECT *, CASE WHEN injections_before = 2 THEN greatest(1, by_profile // 2) ELSE by_profile END AS effective_limit FROM ("
                  "SELECT *, CASE WHEN limit_multiplier > 1 THEN greatest(1, by_score // limit_multiplier) ELSE by_score END AS by_profile FROM ("
                  f"SELECT *, CAST({MULTIPLIER} AS INT) AS limit_multiplier, CASE WHEN input_score >= 80 THEN 3 WHEN input_score >= 50 THEN 6 WHEN input_score >= 30 THEN 15 ELSE 30 END AS by_score FROM prior) a) b")
SQL["effective_limit"] = sql("SELECT event_id, input_score, injections_before, limit_multiplier, effective_limit FROM limited", "limited")
SQL["rate_limit_offline"] = sql(f"""
SELECT CASE WHEN injections_before >= 3 THEN 'aggressive_attacker_cooldown' WHEN current_hits >= effective_limit THEN 'rate_limit_exceeded' ELSE 'allowed' END AS verdict,
  action, count(*) AS requests, {big('sum(current_hits)')} AS hits, {big('sum(event_id)')} AS id_sum FROM limited GROUP BY ALL""", "limited")
CTE["denials"] = (("fx_log",), "SELECT * FROM fx_log WHERE action = 'deny'")
_n = lambda *words: f"count(*) FILTER (WHERE {_code(*words)})"
CTE["profiles"] = (("denials",), f"SELECT client_id, subject, min(us) AS first_us, max(us) AS last_us, count(*) AS refusal_count, {_n('INJECTION', 'JAILBREAK')} AS injection_attempts, "
                   f"{_n('JAILBREAK')} AS jailbreak_attempts, {_n('ESCALATION', 'PRIVILEGE')} AS escalation_attempts, {_n('TOOL')} AS tool_abuse_attempts FROM denials GROUP BY client_id, subject")
SQL["attacker_profiles"] = sql("SELECT * FROM profiles", "profiles")
CTE["clusters"] = (("denials",), f"""SELECT client_id, subject, arg_max(reason_code, (n, oldest)) AS reason_cluster, {big('sum(n)')} AS kept_codes FROM
 (SELECT client_id, subject, reason_code, count(*) AS n, max(rn) AS oldest FROM (SELECT *, row_number() OVER (PARTITION BY client_id, subject ORDER BY us DESC, event_id DESC) AS rn FROM denials) a
  WHERE rn <= {C.REASON_HISTORY} GROUP BY ALL) b GROUP BY client_id, subject""")
SQL["top_reason"] = sql("SELECT * FROM clusters", "clusters")
_susp = "(refusal_count >= 5 AND 1706745600000000 - first_us < 300000000) OR jailbreak_attempts >= 3 OR escalation_attempts >= 2 OR tool_abuse_attempts >= 5"
SQL["suspicious_clients"] = sql(f"SELECT client_id, subject, refusal_count, {_susp} AS suspicious FROM profiles", "profiles")
SQL["limit_multiplier"] = sql(f"SELECT client_id, subject, CAST({MULTIPLIER} AS INT) AS limit_multiplier FROM profiles", "profiles")
SQL["recent_alerts"] = sql(f"""SELECT client_id, subject, refusal_count, jailbreak_attempts, escalation_attempts, tool_abuse_attempts, last_us, reason_cluster FROM
 (SELECT * FROM profiles WHERE {_susp} ORDER BY last_us DESC, client_id, subject LIMIT 50) p JOIN clusters USING (client_id, subject)""", "profiles", "clusters")
SQL["profile_retention"] = sql("SELECT client_id, subject, first_us FROM profiles ORDER BY first_us DESC, client_id, subject LIMIT 60", "profiles")
SQL["guard_call_budget"] = sql("""
SELECT *, calls_before >= 15 AS over_budget, CASE WHEN calls_before >= 15 THEN 'suspicious' END AS fallback_label, CASE WHEN calls_before >= 15 THEN CAST(0.4 AS DOUBLE) END AS fallback_confidence,
  CASE WHEN calls_before >= 15 THEN 35 END AS fallback_risk, CASE WHEN calls_before >= 15 THEN 'allow_with_restrictions' END AS fallback_action,
  CASE WHEN calls_before >= 15 THEN 'llm_guard_rate_limited' END AS fallback_reason FROM
 (SELECT event_id, us, count(*) OVER (ORDER BY us RANGE BETWEEN 3600000000 PRECEDING AND CURRENT ROW) - count(*) OVER (PARTITION BY us ORDER BY event_id DESC ROWS UNBOUNDED PRECEDING) AS calls_before
  FROM fx_log) c""", "fx_log")

# --- classification -------------------------------------------------------

SQL["classify_deterministic"] = sql("SELECT trace_id, label, confidence, reasons FROM class", "class")
_attack = "(" + " OR ".join(has("input_labels", n) for n in ("prompt_injection", "jailbreak_attempt", "secret_exfiltration", "exploit_intent")) + ")"
_sens = "(" + " OR ".join(has("dlp_labels", n) for n in ("secret", "pii", "financial")) + ")"
_hard = f"guard_label IN {C.HARD_ATTACK_LABELS}"
_high = "(input_score >= 50 OR dlp_score >= 40 OR " + " OR ".join(has("input_labels", n) for n in ("prompt_injection", "jailbreak_attempt", "secret_exfiltration")) + ")"
CTE["guard_in"] = (("risk", "fx_guard"), f"""SELECT *, CASE
  WHEN guard_label = 'secret_exfiltration_intent' AND NOT {_attack} AND {_sens} THEN 'submission'
  WHEN {_hard} AND guard_confidence >= 0.75 AND NOT ({_attack} OR input_score >= 50) THEN 'unconfirmed'
  WHEN guard_label IS NOT NULL AND guard_action IN ('allow', 'allow_with_restrictions') AND {_high} AND guard_confidence < 0.95 THEN 'conflict'
  WHEN ({_hard} OR guard_label = 'sensitive_data_submission') AND guard_confidence >= 0.75 THEN 'accepted' ELSE 'rules' END AS way, {_sens} AS sens
 FROM risk LEFT JOIN fx_guard USING (trace_id)""")
SQL["classify_with_guard"] = sql(f"""
SELECT trace_id, CASE way WHEN 'submission' THEN 'sensitive_data_submission' WHEN 'unconfirmed' THEN CASE WHEN sens THEN 'sensitive_data_submission' ELSE 'suspicious' END
    WHEN 'accepted' THEN guard_label ELSE {class_case(0)} END AS label,
  CASE way WHEN 'submission' THEN least(CAST(0.9 AS DOUBLE), guard_confidence) WHEN 'unconfirmed' THEN CASE WHEN sens THEN CAST(0.8 AS DOUBLE) ELSE CAST(0.7 AS DOUBLE) END
    WHEN 'accepted' THEN guard_confidence ELSE {class_case(1)} END AS confidence,
  CASE way WHEN 'submission' THEN 'secret_submission_without_exfiltration_request' WHEN 'unconfirmed' THEN 'llm_guard_unconfirmed_by_deterministic_signals'
    WHEN 'accepted' THEN 'model_verdict' WHEN 'conflict' THEN CASE WHEN {class_case(2)} = 'no_material_risk_signals' THEN 'no_material_risk_signals'
      ELSE 'llm_guard_conflict_with_deterministic,' || {class_case(2)} END ELSE {class_case(2)} END AS reasons FROM guard_in""", "guard_in")
SQL["class_features"] = sql("""SELECT trace_id, input_score, dlp_score, risk_score, risk_state, input_labels, dlp_labels, guard_label, guard_confidence, guard_risk,
  CASE WHEN way = 'conflict' THEN CAST(0.3 AS DOUBLE) END AS guard_confidence_adjusted FROM guard_in""", "guard_in")

# --- policy ---------------------------------------------------------------

_old, _new = shipped(), shipped("candidate")
_kinds = {}
for _r in _old.rules:
    for _k, _v in _r["condition"].items():
        _kinds[f"{_k}={_v}"] = (_k, _v)
SQL["policy_conditions"] = sql(" UNION ALL ".join(
    f"SELECT {q(n)} AS condition, count(*) FILTER (WHERE {condition_sql(k, v)}) AS requests FROM class" for n, (k, v) in _kinds.items()), "class")
SQL["policy_decide"] = sql("SELECT trace_id, rule_name, action, reason_code FROM dec", "dec")
CTE["matched"] = (("class",), "SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY rule_ord) AS rn FROM (" + " UNION ALL ".join(
    f"SELECT trace_id, {i} AS rule_ord, {q(r['name'])} AS rule_name FROM class WHERE {rule_sql(r)}" for i, r in enumerate(_old.rules) if r["enabled"]) + ") m")
SQL["policy_all_matches"] = sql("SELECT trace_id, rule_ord, rule_name, rn > 1 AS shadowed FROM matched", "matched")
SQL["rule_coverage"] = sql("""SELECT r.rule_ord, r.rule_name, r.enabled, count(m.rule_ord) AS matched, count(*) FILTER (WHERE m.rn = 1) AS decided,
  count(*) FILTER (WHERE m.rn = 1) = 0 AS never_decides FROM rules r LEFT JOIN matched m USING (rule_ord) WHERE r.rule_ord >= 0 GROUP BY ALL""", "rules", "matched")
CTE["runs"] = (("class", "rules", "new_rules"), f"""SELECT b.*, o.action AS old_action, n.action AS new_action FROM (SELECT trace_id, {decided_sql(_old)} AS old_ord, {decided_sql(_new)} AS new_ord FROM class) b
  JOIN rules o ON o.rule_ord = b.old_ord JOIN new_rules n ON n.rule_ord = b.new_ord""")
SQL["policy_backtest"] = sql(
    "SELECT old_action, new_action, count(*) AS requests FROM runs GROUP BY ALL", "runs")
SQL["policy_decide_indexed"] = sql("SELECT trace_id, rule_ord FROM dec", "dec")
SQL["policy_backtest_indexed"] = SQL["policy_backtest"]


def _implied(narrow: dict, wide: dict) -> str:
    """SQL truth of a rule's conditions implying another's, stated over the two lists of conditions."""
    def one(k, v):
        same = [w for n, w in narrow.items() if n == k]
        return " OR ".join(f"{w} >= {v}" if k.endswith("_gte") else f"{q(str(w))} = {q(str(v))}" for w in same) or "FALSE"
    return " AND ".join(f"({one(k, v)})" for k, v in wide.items()) or "TRUE"


def _implications() -> str:
    on = [(i, r) for i, r in enumerate(_old.rules) if r["enabled"]]
    pairs = ", ".join(f"({i}, {j}, {_implied(a['condition'], b['condition'])}, {_implied(b['condition'], a['condition'])}, {str(a['decision'] == b['decision']).upper()})"
                      for i, a in on for j, b in on if i < j)
    return f"""SELECT earlier, later, CASE WHEN back THEN 'never_decides' ELSE 'exception' END AS relation, same_decision,
  (SELECT count(*) FROM matched m WHERE m.rule_ord = CASE WHEN back THEN later ELSE earlier END) AS requests
 FROM (VALUES {pairs}) p(earlier, later, there, back, same_decision) WHERE there OR back"""


SQL["rule_implications"] = sql(_implications(), "matched")
SQL["policy_controls"] = sql("SELECT trace_id, disable_tools, allow_retrieval, max_context_sensitivity, require_human_approval, response_mode, enforce_token_budget FROM dec", "dec")


def _change() -> str:
    old = {r["name"]: (i, {k: v for k, v in r.items() if k != "name"}) for i, r in enumerate(_old.rules)}
    new = {r["name"]: (i, {k: v for k, v in r.items() if k != "name"}) for i, r in enumerate(_new.rules)}
    rows = []
    for name in {**old, **new}:
        o, n = old.get(name), new.get(name)
        change = ("added" if o is None else "removed" if n is None else "changed" if o[1] != n[1] else "moved" if o[0] != n[0] else "same")
        num = lambda x: "CAST(NULL AS INT)" if x is None else str(x[0])
        rows.append(f"({q(name)}, {num(o)}, {num(n)}, {q(change)})")
    return "(VALUES " + ", ".join(rows) + ") d(rule_name, old_ord, new_ord, change)"


SQL["bundle_diff"] = sql(f"""SELECT rule_name, d.old_ord, d.new_ord, change, (SELECT count(*) FROM runs b WHERE b.old_ord = d.old_ord) AS old_decided,
  (SELECT count(*) FROM runs b WHERE b.new_ord = d.new_ord) AS new_decided FROM {_change()}""", "runs")


def _replay() -> str:
    """Requests of a subject one after the other, its sessions and clients as maps."""
    base = """SELECT subject, client_id, CAST(session_id AS VARCHAR) || '-' || strftime(ts, '%Y%m%d') AS session_id, event_id AS request_id, us, input_score,
  dlp_score % 45 AS dlp_score, CASE WHEN reason_code = 'PROMPT_INJECTION_DETECTED' THEN 'prompt_injection' WHEN reason_code = 'JAILBREAK_ATTEMPT_DETECTED' THEN 'jailbreak_attempt'
   WHEN event_id % 9 = 0 THEN 'hate_content' WHEN event_id % 9 = 1 THEN 'insult_content' ELSE '' END AS input_labels, '' AS dlp_labels, 'llm:chat' AS permissions_csv,
  event_id % 2 = 0 AS step_up, event_id % 11 = 0 AS has_control_chars, event_id % 13 = 0 AS has_system_messages, event_id % 17 = 0 AS has_developer_messages,
  CASE WHEN tool_used THEN 0 ELSE -1 END AS tool_rank FROM fx_log"""
    classed = f"SELECT *, {class_case(0)} AS label, {class_case(1)} AS confidence FROM by_state"
    zero_s = "{'requests': 0, 'refusals': 0, 'escalations': 0, 'tools': 0}"
    zero_c = "{'hits': CAST([] AS BIGINT[]), 'until': CAST(0 AS BIGINT), 'injections': 0, 'jailbreaks': 0, 'escalations': 0}"
    naming = lambda *words: "len(list_filter(string_split(reason_code, ','), lambda c: " + " OR ".join(f"contains(c, {q(w)})" for w in words) + "))"
    return f"""SELECT * FROM (WITH RECURSIVE
base AS ({base}),
by_state AS (SELECT b.*, s.risk_state FROM base b, (VALUES ('normal'), ('elevated'), ('restricted'), ('blocked')) s(risk_state)),
classed AS ({classed}),
grouped AS (SELECT subject, client_id, session_id, request_id, us, input_score, tool_rank,
   CASE WHEN input_score >= 70 THEN 20 ELSE 0 END + CASE WHEN has_control_chars THEN 10 ELSE 0 END + CASE WHEN has_system_messages THEN 15 ELSE 0 END
   + CASE WHEN has_developer_messages THEN 15 ELSE 0 END AS base_points,
   map_from_entries(list({{'k': risk_state, 'v': {decided_sql(_old)}}})) AS ords
  FROM classed GROUP BY ALL),
ordered AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY subject ORDER BY us, request_id) AS n FROM grouped),
effects AS MATERIALIZED (SELECT rule_ord, action, {naming('INJECTION', 'JAILBREAK')} AS inj, {naming('JAILBREAK')} AS jail, {naming('ESCALATION', 'PRIVILEGE')} AS esc,
   CASE WHEN disable_tools THEN -1 ELSE {rank('max_context_sensitivity', C.SENSITIVITY_RANK)} END AS ceiling FROM rules),
run AS (
 SELECT subject, CAST(0 AS BIGINT) AS n, CAST(MAP {{}} AS MAP(VARCHAR, STRUCT(requests INT, refusals INT, escalations INT, tools INT))) AS sessions,
   CAST(MAP {{}} AS MAP(VARCHAR, STRUCT(hits BIGINT[], until BIGINT, injections INT, jailbreaks INT, escalations INT))) AS clients,
   CAST(NULL AS BIGINT) AS request_id, CAST(NULL AS VARCHAR) AS verdict, CAST(NULL AS STRUCT(requests INT, refusals INT, escalations INT, tools INT)) AS seen,
   CAST(NULL AS INT) AS points, CAST(NULL AS VARCHAR) AS risk_state, CAST(NULL AS VARCHAR) AS action, CAST(NULL AS INT) AS rule_ord
 FROM (SELECT DISTINCT subject FROM ordered)
 UNION ALL
 SELECT subject, n, map_concat(sessions, MAP {{session_id: {{'requests': s.requests, 'refusals': s.refusals + denied, 'escalations': s.escalations
      + CASE WHEN denied = 1 AND s.refusals >= 1 AND input_score >= 60 THEN 1 ELSE 0 END,
      'tools': s.tools + CASE WHEN denied = 0 AND action IS NOT NULL AND action <> 'challenge' AND tool_rank >= 0 AND tool_rank <= ceiling THEN 1 ELSE 0 END}}}}),
   map_concat(clients, MAP {{CAST(client_id AS VARCHAR): {{'hits': CASE WHEN verdict = 'allowed' THEN list_append(recent, us) ELSE recent END,
      'until': CAST(CASE WHEN verdict = 'aggressive_attacker_cooldown' THEN us + {C.COOLDOWN_S * 1_000_000} ELSE c.until END AS BIGINT),
      'injections': CAST(c.injections + denied * coalesce(inj, 0) AS INT), 'jailbreaks': CAST(c.jailbreaks + denied * coalesce(jail, 0) AS INT), 'escalations': CAST(c.escalations + denied * coalesce(esc, 0) AS INT)}}}}),
   request_id, verdict, s, points, risk_state, action, rule_ord
 FROM (SELECT z.*, e.action, e.inj, e.jail, e.esc, e.ceiling, CASE WHEN e.action = 'deny' THEN 1 ELSE 0 END AS denied FROM
  (SELECT y.*, CAST(ords[risk_state] AS INT) AS rule_ord FROM
   (SELECT x.*, CASE WHEN verdict = 'allowed' THEN CASE WHEN points0 >= 80 THEN 'blocked' WHEN points0 >= 50 THEN 'restricted' WHEN points0 >= 20 THEN 'elevated' ELSE 'normal' END END AS risk_state,
      CASE WHEN verdict = 'allowed' THEN CAST(least(points0, {C.SCORE_CAP}) AS INT) END AS points FROM
    (SELECT w.*, CASE WHEN us < c.until THEN 'cooldown_active' WHEN s.refusals >= 3 THEN 'aggressive_attacker_cooldown'
       WHEN len(recent) >= CASE WHEN s.refusals = 2 THEN greatest(1, by_profile // 2) ELSE by_profile END THEN 'rate_limit_exceeded' ELSE 'allowed' END AS verdict,
      base_points + CASE WHEN s.refusals >= 3 THEN 40 ELSE 0 END + CASE WHEN s.tools >= 5 THEN 20 ELSE 0 END + CASE WHEN s.requests >= 20 THEN 15 ELSE 0 END
       + CASE WHEN s.refusals >= 2 THEN 20 ELSE 0 END + CASE WHEN s.escalations >= 1 THEN 25 ELSE 0 END AS points0 FROM
     (SELECT v.*, CASE WHEN factor > 1 THEN greatest(1, by_score // factor) ELSE by_score END AS by_profile FROM
      (SELECT u.*, {{'requests': s0.requests + 1, 'refusals': s0.refusals, 'escalations': s0.escalations, 'tools': s0.tools}} AS s,
         CASE WHEN us < c.until THEN c.hits ELSE list_filter(c.hits, lambda h: us - h <= {C.RATE_WINDOW_S * 1_000_000}) END AS recent,
         CASE WHEN input_score >= 80 THEN {max(1, C.RATE_LIMIT // 10)} WHEN input_score >= 50 THEN {max(1, C.RATE_LIMIT // 5)} WHEN input_score >= 30 THEN {max(1, C.RATE_LIMIT // 2)} ELSE {C.RATE_LIMIT} END AS by_score,
         least(20, CASE WHEN c.jailbreaks >= 3 THEN 5 ELSE 1 END * CASE WHEN c.escalations >= 2 THEN 3 ELSE 1 END * CASE WHEN c.injections >= 5 THEN 2 ELSE 1 END) AS factor FROM
       (SELECT o.*, r.sessions, r.clients, coalesce(r.sessions[o.session_id], {zero_s}) AS s0, coalesce(r.clients[CAST(o.client_id AS VARCHAR)], {zero_c}) AS c
        FROM run r JOIN ordered o ON o.subject = r.subject AND o.n = r.n + 1) u) v) w) x) y) z LEFT JOIN effects e ON e.rule_ord = z.rule_ord))
SELECT o.subject, o.client_id, o.session_id, o.request_id, o.us, r.verdict, r.seen.requests AS request_count, r.seen.refusals AS refusal_count,
  r.seen.refusals AS injection_attempt_count, r.seen.escalations AS escalation_pattern_count, r.seen.tools AS tool_request_count,
  r.points AS risk_score, r.risk_state, r.action, r.rule_ord FROM run r JOIN ordered o ON o.request_id = r.request_id)"""


_all = "subject, client_id, session_id, request_id, us, verdict, request_count, refusal_count, injection_attempt_count, escalation_pattern_count, tool_request_count, risk_score, risk_state, action, rule_ord"
CTE["replayed"] = (("fx_log", "rules"), _replay())
SQL["rate_limit_rounds"] = sql(f"SELECT {_all} FROM replayed", "replayed")
SQL["rate_limit_exact"] = sql("SELECT request_id, client_id, subject, us, verdict FROM replayed", "replayed")
SQL["stream_session_state"] = sql("SELECT * EXCLUDE (client_id, verdict) FROM replayed", "replayed")
