"""Named CTEs shared by the oracle SQL, rendered for DuckDB (RE2 patterns)."""

from __future__ import annotations

import re

from guardlake import catalog as C
from guardlake.functions.text import WHITE_SPACE
from guardlake.sources import tables as T


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str, ignore_case: bool = False) -> str:
    return ("(?i)" if ignore_case else "") + re.sub(r"(?<!\\)\\u([0-9A-Fa-f]{4})", r"\\x{\1}", pattern)


def hit(col: str, pattern: str, ignore_case: bool = False) -> str:
    return f"regexp_matches({col}, {q(re2(pattern, ignore_case))})"


def any_hit(col: str, patterns, ignore_case: bool = False) -> str:
    return "(" + " OR ".join(hit(col, p, ignore_case) for p in patterns) + ")"


def count_of(col: str, pattern: str) -> str:
    return f"len(regexp_extract_all({col}, {q(re2(pattern, True))}))"


def strip(expr: str) -> str:
    return f"trim({expr}, {q(WHITE_SPACE)})"


def feeds(expr: str) -> str:
    return f"replace(replace({expr}, chr(13) || chr(10), chr(10)), chr(13), chr(10))"


def norm(expr: str) -> str:
    return strip(feeds(f"regexp_replace({expr}, {q(C.CONTROL_CHARS)}, '', 'g')"))


def sanitize(expr: str) -> str:
    return strip(feeds(f"regexp_replace(replace({expr}, chr(0), ''), '[ \\t]+', ' ', 'g')"))


def tokens(expr: str) -> str:
    return f"greatest(1, len({expr}) // 4)"


def rank(col: str, ranks: dict[str, int]) -> str:
    return f"CASE {col} " + " ".join(f"WHEN {q(k)} THEN {v}" for k, v in ranks.items()) + " END"


def big(expr: str) -> str:
    return f"CAST({expr} AS BIGINT)"


def rewrite(expr: str, rule: C.Rewrite) -> str:
    mark = (r"\1\2" if rule.keep else "") + rule.mark
    return f"regexp_replace({expr}, {q(re2(rule.text, rule.ignore_case))}, {q(mark)}, 'g')"


def rewritten(expr: str, rules) -> str:
    for rule in rules:
        expr = rewrite(expr, rule)
    return expr


def leaks_redacted(expr: str) -> str:
    for phrase in C.OUTPUT_LEAK_PHRASES:
        expr = f"regexp_replace({expr}, {q('(?i)' + phrase)}, {q(C.OUTPUT_LEAK_MARK)}, 'g')"
    return expr


def csv_of(names, flag) -> str:
    return "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {flag(n)} > 0 THEN {q(n)} END" for n in names) + \
        "], lambda x: x IS NOT NULL), ',')"


# --- families and detectors as summed CASEs -------------------------------

def pattern_flags(family: C.Family, text: str = "content", low: str = "low") -> list[tuple[str, str]]:
    """(reported pattern, boolean SQL) pairs."""
    col = low if family.lowered else text
    if family.any_of:
        return [(family.any_of, any_hit(col, [p.text for p in family.patterns], family.ignore_case))]
    return [(p.text, hit(col, p.text, family.ignore_case)) for p in family.patterns]


def points_sql(families=C.FAMILIES, text="content", low="low") -> str:
    terms = [f"CASE WHEN {test} THEN {f.weight} ELSE 0 END" for f in families for _, test in pattern_flags(f, text, low)]
    return " + ".join(terms)


def signal_count_sql(families=C.FAMILIES, text="content", low="low") -> str:
    return " + ".join(f"CASE WHEN {test} THEN 1 ELSE 0 END" for f in families for _, test in pattern_flags(f, text, low))


def label_sql(label: str, text="content", low="low") -> str:
    if label == C.LEAK_LABEL:
        tests = [hit(low, p) for p in C.LEAK_PHRASES]
    else:
        tests = [test for f in C.FAMILIES if f.category == label for _, test in pattern_flags(f, text, low)]
    return "CASE WHEN " + " OR ".join(tests) + " THEN 1 ELSE 0 END"


def scan_columns(text="content", low="low") -> str:
    return (f"{points_sql(text=text, low=low)} AS scan_points, {signal_count_sql(text=text, low=low)} AS signal_count, "
            + ", ".join(f"{label_sql(n, text, low)} AS is_{n}" for n in C.INPUT_LABELS))


def severity_points(d: C.Detector) -> int:
    return C.SEVERITY_SCORE.get(d.severity, 5)


def counts_sql(text="content", detectors=C.DETECTORS) -> str:
    return ", ".join(f"{count_of(text, d.text)} AS n_{d.name}" for d in detectors)


def dlp_total(detectors, weight=lambda d: 1) -> str:
    return " + ".join(f"n_{d.name} * {weight(d)}" for d in detectors) or "0"


def dlp_columns(detectors=C.DETECTORS) -> str:
    flag = lambda label: dlp_total([d for d in detectors if d.category == label])
    return (f"{dlp_total(detectors, severity_points)} AS dlp_points, {dlp_total(detectors)} AS match_count, "
            f"{dlp_total([d for d in detectors if d.severity == 'critical'])} AS critical_count, "
            f"{dlp_total([d for d in detectors if d.severity == 'high'])} AS high_count, "
            + ", ".join(f"CASE WHEN {flag(n)} > 0 THEN 1 ELSE 0 END AS dlp_{n}" for n in C.DLP_LABELS))


# --- CTEs ------------------------------------------------------------------

_given = dict(conversations="conversations", documents="documents", events="events")


def overlay(sql: str) -> str:
    return sql.replace("{ten}", T.TEN_DUCK).format(**_given)


WEIGHT = (f"CASE WHEN role IN {C.ROLES} AND len(content) BETWEEN {C.MIN_CONTENT} AND {C.MAX_CONTENT} "
          f"THEN strlen(content) ELSE {C.MAX_REQUEST_BYTES + 1} END")
REJECTED = f"role IS NULL OR role NOT IN {C.ROLES} OR content IS NULL OR len(content) NOT BETWEEN {C.MIN_CONTENT} AND {C.MAX_CONTENT}"
UPTO = "OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"

CTE: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_messages": ((), overlay(T.FX_MESSAGES)),
    "fx_requests": ((), overlay(T.FX_REQUESTS)),
    "fx_chunks0": ((), overlay(T.FX_CHUNKS)),
    "fx_chunks": (("fx_chunks0",), "SELECT *, CASE WHEN bad_hash THEN 'bad' ELSE sha256(chunk_text) END AS content_hash FROM fx_chunks0"),
    "fx_log": ((), "SELECT *, epoch_us(ts) AS us FROM (" + overlay(T.FX_LOG) + ") l"),
    "fx_attachments": ((), overlay(T.FX_ATTACHMENTS)),
    "fx_candidates": ((), overlay(T.FX_CANDIDATES)),
    "fx_guard": ((), overlay(T.FX_GUARD)),
    "fx_guard_raw": ((), overlay(T.FX_GUARD_RAW)),
    "fx_responses": ((), overlay(T.FX_RESPONSES.replace("{fx_messages}", T.FX_MESSAGES))),
    "norm": (("fx_messages",), f"SELECT conv_id, turn, role, content AS raw, {norm('content')} AS content, "
             f"{hit('content', C.CONTROL_CHARS)} AS has_control_chars, {WEIGHT} AS bytes FROM fx_messages"),
    "low": (("norm",), "SELECT *, lower(content) AS low FROM norm"),
    "msg_scan": (("low",), f"SELECT conv_id, turn, role, bytes, has_control_chars, {scan_columns()}, {counts_sql()} FROM low"),
    "msg_feat": (("msg_scan",), f"SELECT *, {dlp_columns()} FROM msg_scan"),
    "within": (("norm",), f"SELECT * FROM (SELECT conv_id, turn, role, raw, content, sum(bytes) {UPTO} AS request_bytes FROM norm) w "
               f"WHERE request_bytes <= {C.MAX_REQUEST_BYTES}"),
    "att_n": (("fx_attachments",), f"SELECT *, {counts_sql('att_text')}, {counts_sql('meta', C.METADATA_DETECTORS)} FROM "
              "(SELECT *, coalesce(name, '') || ' ' || chr(124) || ' ' || coalesce(content_type, '') || ' ' || chr(124) || ' ' || coalesce(uri, '') AS meta FROM fx_attachments) a"),
    "att_feat": (("att_n",), f"SELECT trace_id, sum(dlp_points) AS att_points, count(*) AS attachment_count, "
                 + ", ".join(f"max(dlp_{n}) AS att_{n}" for n in C.DLP_LABELS)
                 + f" FROM (SELECT trace_id, {dlp_columns(C.DETECTORS + C.METADATA_DETECTORS)} FROM att_n) a GROUP BY trace_id"),
    "run": (("msg_feat",), "SELECT * FROM (SELECT conv_id, turn, role, "
            + ", ".join(f"sum({n}) {UPTO} AS {n}" for n in ("bytes", "scan_points", "signal_count", "dlp_points", "match_count"))
            + ", " + ", ".join(f"max({n}) {UPTO} AS {n}" for n in [*[f"is_{x}" for x in C.INPUT_LABELS], *[f"dlp_{x}" for x in C.DLP_LABELS]])
            + f", bool_or(has_control_chars) {UPTO} AS has_control_chars, bool_or(role = 'system') {UPTO} AS has_system_messages"
            + f", bool_or(role = 'developer') {UPTO} AS has_developer_messages, count(*) {UPTO} AS message_count"
            + f", count(*) FILTER (WHERE role = 'user') {UPTO} AS request_count FROM msg_feat) r "
            + f"WHERE bytes <= {C.MAX_REQUEST_BYTES} AND role = 'user'"),
    "feat": (("run", "fx_requests", "att_feat"),
             "SELECT q.*, CAST(least(100, r.scan_points) AS INT) AS input_score, CAST(r.signal_count AS BIGINT) AS signal_count, "
             "CAST(least(100, r.dlp_points + coalesce(a.att_points, 0)) AS INT) AS dlp_score, "
             "r.has_control_chars, r.has_system_messages, r.has_developer_messages, r.message_count, r.request_count, "
             "coalesce(a.attachment_count, 0) AS attachment_count, "
             + csv_of(C.INPUT_LABELS, lambda n: f"r.is_{n}") + " AS input_labels, "
             + csv_of(C.DLP_LABELS, lambda n: f"greatest(r.dlp_{n}, coalesce(a.att_{n}, 0))") + " AS dlp_labels "
             "FROM run r JOIN fx_requests q USING (conv_id, turn) LEFT JOIN att_feat a USING (trace_id)"),
}


def has(col: str, label: str) -> str:
    """Label test on a comma-joined list."""
    return f"list_contains(string_split({col}, ','), {q(label)})"


# --- risk, classification, policy -----------------------------------------

RISK_TERMS = (
    ("refusal_count >= 3", 40, "multiple_prior_refusals"),
    ("tool_request_count >= 5", 20, "high_tool_request_volume"),
    ("request_count >= 20", 15, "high_session_request_volume"),
    ("injection_attempt_count >= 2", 20, "cumulative_injection_attempts"),
    ("escalation_pattern_count >= 1", 25, "escalation_pattern_detected"),
    ("input_score >= 70", 20, "high_current_input_risk"),
    ("has_control_chars", 10, "control_chars_present"),
    ("has_system_messages", 15, "user_supplied_system_message"),
    ("has_developer_messages", 15, "user_supplied_developer_message"),
)


def risk_select(source: str) -> str:
    total = " + ".join(f"CASE WHEN {t} THEN {p} ELSE 0 END" for t, p, _ in RISK_TERMS)
    reasons = "array_to_string(list_filter([" + ", ".join(f"CASE WHEN {t} THEN {q(n)} END" for t, _, n in RISK_TERMS) + "], lambda x: x IS NOT NULL), ',')"
    return (f"SELECT *, CAST(least(100, points) AS INT) AS risk_score, CASE WHEN points >= 80 THEN 'blocked' WHEN points >= 50 THEN 'restricted' "
            f"WHEN points >= 20 THEN 'elevated' ELSE 'normal' END AS risk_state FROM (SELECT *, {total} AS points, {reasons} AS risk_reasons FROM {source}) x")


CLASS_RULES = (
    (has("input_labels", "prompt_leakage"), "prompt_injection", 0.95, "prompt_leakage_signal"),
    (has("input_labels", "prompt_injection"), "prompt_injection", 0.90, "prompt_injection_signal"),
    (has("input_labels", "jailbreak_attempt"), "jailbreak_attempt", 0.90, "jailbreak_attempt_signal"),
    (has("input_labels", "secret_exfiltration"), "secret_exfiltration_intent", 0.95, "secret_exfiltration_signal"),
    (has("input_labels", "exploit_intent"), "exploit_or_malware_intent", 0.90, "exploit_intent_signal"),
    (f"({has('dlp_labels', 'secret')} OR {has('dlp_labels', 'financial')})", "sensitive_data_submission", 0.88, "sensitive_content_detected"),
    ("input_score >= 50", "jailbreak_attempt", 0.80, "high_input_scan_score"),
    ("(input_score >= 20 OR dlp_score >= 20 OR risk_state IN ('elevated', 'restricted'))", "suspicious", 0.65, "elevated_heuristic_signals"),
)


def class_case(which: int) -> str:
    """Waterfall CASE for the label (0), confidence (1) or reason (2)."""
    pick = lambda label, confidence, reason: (q(label), f"CAST({confidence} AS DOUBLE)", q(reason))[which]
    return ("CASE " + " ".join(f"WHEN {t} THEN {pick(a, b, c)}" for t, a, b, c in CLASS_RULES)
            + f" ELSE {pick('benign', 0.90, 'no_material_risk_signals')} END")


def condition_sql(key: str, v) -> str:
    kinds = {
        "missing_permission": lambda: f"NOT {has('permissions_csv', v)}",
        "input_scan_has_label": lambda: has("input_labels", v),
        "input_scan_score_gte": lambda: f"input_score >= {v}",
        "session_risk_state": lambda: f"risk_state = {q(v)}",
        "step_up_authenticated": lambda: f"step_up = {str(v).upper()}",
        "dlp_has_label": lambda: has("dlp_labels", v),
        "dlp_score_gte": lambda: f"dlp_score >= {v}",
        "classification_label": lambda: f"label = {q(v)}",
        "classification_confidence_gte": lambda: f"confidence >= {v}",
    }
    return f"coalesce({kinds[key]()}, FALSE)" if key in kinds else "FALSE"


def rule_sql(rule: dict) -> str:
    return "(" + (" AND ".join(condition_sql(k, v) for k, v in rule["condition"].items()) or "TRUE") + ")"


def decided_sql(bundle) -> str:
    return "CASE " + " ".join(f"WHEN {rule_sql(r)} THEN {i}" for i, r in enumerate(bundle.rules) if r["enabled"]) + " ELSE -1 END"


def bundle_values(bundle) -> str:
    """The bundle as a VALUES list: ord, name, enabled, conditions, action, reason, controls."""
    b = lambda v: str(v).upper()
    def row(i, name, c, conditions, enabled=True):
        return (f"({i}, {q(name)}, {b(enabled)}, {conditions}, {q(c['action'])}, {q(','.join(c['reason_codes']))}, {b(c['disable_tools'])}, "
                f"{b(c['allow_retrieval'])}, {q(c['max_context_sensitivity'])}, {b(c['require_human_approval'])}, {q(c['response_mode'])}, {b(c['enforce_token_budget'])})")
    rows = [row(i, r["name"], r["decision"], len(r["condition"]), r["enabled"]) for i, r in enumerate(bundle.rules)] + [row(-1, "default", bundle.default, 0)]
    return ("SELECT * FROM (VALUES " + ", ".join(rows) + ") v(rule_ord, rule_name, enabled, condition_count, action, reason_code, disable_tools, allow_retrieval, "
            "max_context_sensitivity, require_human_approval, response_mode, enforce_token_budget)")


def register_policy():
    from guardlake.sources.bundle import shipped
    CTE["rules"] = ((), bundle_values(shipped()))
    CTE["new_rules"] = ((), bundle_values(shipped("candidate")))
    CTE["feat0"] = (("feat",), "SELECT *, 0 AS refusal_count, 0 AS tool_request_count, 0 AS injection_attempt_count, 0 AS escalation_pattern_count FROM feat")
    CTE["risk"] = (("feat0",), risk_select("feat0"))
    CTE["class"] = (("risk",), f"SELECT *, {class_case(0)} AS label, {class_case(1)} AS confidence, {class_case(2)} AS reasons FROM risk")
    CTE["ords"] = (("class",), f"SELECT *, {decided_sql(shipped())} AS rule_ord FROM class")
    CTE["dec"] = (("ords", "rules"), "SELECT o.*, r.* EXCLUDE (rule_ord) FROM ords o JOIN rules r USING (rule_ord)")


register_policy()


def sql(body: str, *names: str) -> str:
    """``WITH`` the named CTEs and what they depend on, then the body."""
    order: list[str] = []

    def need(name: str) -> None:
        for dep in CTE[name][0]:
            need(dep)
        if name not in order:
            order.append(name)

    for name in names:
        need(name)
    head = ", ".join(f"{n} AS MATERIALIZED ({CTE[n][1]})" for n in order)
    return (f"WITH {head} " if head else "") + body
