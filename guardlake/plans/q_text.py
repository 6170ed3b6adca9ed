"""Queries over texts: sources, normalisation, threat scan, DLP and redaction."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import audit, dlp, redact, scan, tools
from guardlake.operators import normalize as N
from guardlake.functions import text as T
from guardlake.plans import flow
from guardlake.plans.registry import csv, query
from guardlake.sources import audit_store, bundle, keyed_state, messages, sinks, tables
from guardlake.spark import shared_folder

KEYS = ["conv_id", "turn"]


def normed(spark, folder):
    return N.normalize(tables.fx_messages(spark, folder))


# --- sources and sinks ----------------------------------------------------

@query("load_messages")
def load_messages(spark, folder):
    conv = tables.table(spark, folder, "conversations")
    requests = conv.select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("trace_id"), F.array(
        F.struct("role", F.col("text").alias("content")),
        F.struct(F.lit("developer").alias("role"), F.concat(F.lit("turn "), F.col("turn").cast("string")).alias("content"))).alias("messages"))
    return messages.messages(requests)


@query("coerce_message_content")
def coerce_message_content(spark, folder):
    conv = tables.table(spark, folder, "conversations")
    t = F.regexp_replace("text", "[^A-Za-z ]", "")
    shape = (F.col("conv_id") + F.col("turn")) % 5
    raw = (F.when(shape == 0, F.concat(F.lit('"'), t, F.lit('"')))
           .when(shape == 1, F.concat(F.lit('[{"type":"text","text":"'), t, F.lit(
               '"},{"type":"image_url","text":"x"},{"type":"INPUT_TEXT","text":" b "}]')))
           .when(shape == 2, "42").when(shape == 3, "null").otherwise("[]"))
    rows = conv.select("conv_id", "turn", F.when(F.col("turn") % 3 == 2, "robot").otherwise(F.col("role")).alias("role"),
                       raw.alias("content_json"))
    return messages.coerce_messages(rows)


@query("policy_bundle")
def policy_bundle(spark, folder):
    rules = bundle.rule_table(spark, bundle.shipped())
    decided = flow.decisions_of(spark, folder).groupBy("rule_ord").agg(F.count(F.lit(1)).alias("decided"))
    return (rules.join(decided, "rule_ord", "left")
            .select("rule_ord", "rule_name", "enabled", "condition_count", "action", csv("reason_codes").alias("reason_code"),
                    "max_context_sensitivity", "response_mode", F.coalesce("decided", F.lit(0)).alias("decided")))


@query("tool_registry")
def tool_registry(spark, folder):
    calls = (tables.fx_requests(spark, folder).filter(F.col("tool_name").isNotNull())
             .groupBy("tool_name").agg(F.count(F.lit(1)).alias("requested_calls")))
    return (tools.tool_registry(spark).join(calls, "tool_name", "left")
            .withColumn("requested_calls", F.coalesce("requested_calls", F.lit(0))))


@query("pattern_catalog")
def pattern_catalog(spark, folder):
    rows = [(f.key, f.category, f.severity, f.weight, f.any_of or p.text)
            for f in C.FAMILIES for p in (f.patterns[:1] if f.any_of else f.patterns)]
    listed = spark.createDataFrame(rows, "family string, category string, severity string, weight int, pattern string")
    hits = (scan.signals_long(normed(spark, folder), nested=False)
            .groupBy("category", "pattern").agg(F.count(F.lit(1)).alias("messages_hit")))
    return (listed.join(hits, ["category", "pattern"], "left")
            .withColumn("messages_hit", F.coalesce("messages_hit", F.lit(0))))


@query("load_chunks")
def load_chunks(spark, folder):
    return tables.fx_chunks(spark, folder).select(
        "chunk_id", "document_id", "chunk_tenant", "sensitivity", "content_hash", F.char_length("chunk_text").alias("chunk_chars"))


def audit_rows(spark, folder):
    log = tables.fx_log(spark, folder)
    return log.select("event_id", "us", "session_id", "subject", F.col("action").alias("event_type"), "reason_code",
                      F.date_format(F.col("ts"), "yyyy-MM-dd").alias("event_date"))


@query("audit_sink")
def audit_sink(spark, folder):
    path = f"{shared_folder(spark)}/audit-{uuid.uuid4().hex}"
    sinks.write_audit(audit_rows(spark, folder), path)
    schema = "event_id long, us long, session_id long, subject string, reason_code string, event_date string, event_type string"
    return (spark.read.schema(schema).json(path).groupBy("event_date", "event_type")
            .agg(F.count(F.lit(1)).alias("events"), F.min("event_id").alias("first_event"), F.sum("session_id").alias("sessions_sum")))


@query("audit_recent")
def audit_recent(spark, folder):
    return audit.recent_events(audit_rows(spark, folder), limit=50, offset=10).select("event_id", "event_type", "subject", "us")


def stored_audit(spark, folder):
    """The audit rows in a store of two appends, with the rows' columns and the list of dates."""
    rows, path = audit_rows(spark, folder), f"{shared_folder(spark)}/audit-store-{uuid.uuid4().hex}"
    for half in (0, 1):
        audit_store.append(rows.filter(F.col("event_id") % 2 == half), path, "session_id", parts=4, files=2)
    return audit_store.stored(spark, path, rows), spark.read.parquet(f"{path}/dates")


@query("audit_store_lookup")
def audit_store_lookup(spark, folder):
    log = tables.fx_log(spark, folder)
    wanted = log.filter((F.col("action") == "deny") & (F.col("input_score") == 100)).select("session_id").distinct()
    store, _ = stored_audit(spark, folder)
    return audit_store.lookup(store, wanted, "session_id", parts=4).select("event_id", "session_id", "subject", "event_type", "reason_code", "us", "event_date")


@query("audit_store_newest")
def audit_store_newest(spark, folder):
    store, dates = stored_audit(spark, folder)
    return audit_store.newest(store, dates, 50).select("event_id", "event_type", "subject", "us")


@query("decision_log")
def decision_log(spark, folder):
    r = audit.decision_records(flow.records_of(spark, folder))
    return r.select("trace_id", "session_id", "subject", "tenant_id", "request_summary.*",
                    F.col("decisions.session_risk.risk_state").alias("risk_state"),
                    F.col("decisions.input_scan.input_score").alias("input_score"),
                    F.col("decisions.dlp_scan.dlp_score").alias("dlp_score"),
                    F.col("decisions.content_classification.label").alias("label"),
                    F.col("decisions.policy_decision.action").alias("action"),
                    csv("decisions.policy_decision.reason_codes").alias("reason_code"), "outcome_record.*",
                    "decisions.llm_input_guard.guard_label", "decisions.llm_input_guard.guard_risk",
                    "decisions.retrieval_summary.*",
                    F.array_join(F.transform("decisions.tool_decisions", lambda t: F.concat_ws(":", t["tool_name"], t["decision"])), ",").alias("tool_decisions"),
                    csv("decisions.output_guard.output_reasons").alias("output_reasons"),
                    csv("decisions.output_guard.output_signals").alias("output_signals"))


@query("latest_state")
def latest_state(spark, folder):
    writes = tables.fx_log(spark, folder).select(F.col("tenant_id").alias("namespace"), F.col("session_id").alias("key"),
                                                 F.col("action").alias("payload"), F.col("us").alias("updated_at"), "event_id")
    latest = sinks.latest_by_key(writes, ["namespace", "key"], "payload", ["updated_at", "event_id"])
    return sinks.newest(latest, ["updated_at", "event_id"], 100)


@query("latest_state_delta")
def latest_state_delta(spark, folder):
    """The latest state of every key, from three appends (one of them all late) and the compactions after them."""
    writes = tables.fx_log(spark, folder).select(F.col("tenant_id").alias("namespace"), F.col("session_id").alias("key"),
                                                 F.col("action").alias("payload"), F.col("us").alias("updated_at"), "event_id")
    state = keyed_state.State(f"{shared_folder(spark)}/state-{uuid.uuid4().hex}", ("namespace", "key"), "payload", ("updated_at", "event_id"), writes.schema)
    keyed_state.create(spark, state)
    for batch, which in enumerate((1, 0, 2)):
        keyed_state.append(writes.filter(F.col("event_id") % 3 == which), state, batch)
        if batch < 2:
            keyed_state.compact(spark, state, batch, share=0.5)
    return keyed_state.read(spark, state)


# --- normalisation and validation -----------------------------------------

@query("normalize_messages")
def normalize_messages(spark, folder):
    return normed(spark, folder).select("conv_id", "turn", "role", "content", "has_control_chars", "content_length")


@query("trust_label")
def trust_label(spark, folder):
    return (tables.table(spark, folder, "conversations").groupBy("role", T.trust_label(F.col("role")).alias("source_label"))
            .agg(F.count(F.lit(1)).alias("messages")))


@query("request_facts")
def request_facts(spark, folder):
    return N.request_facts(tables.fx_messages(spark, folder), tables.fx_attachments(spark, folder))


@query("attachment_metadata_flags")
def attachment_metadata_flags(spark, folder):
    att = tables.fx_attachments(spark, folder).select("trace_id", N.metadata_flag("name", "content_type", "uri").alias("flagged"))
    pages = tables.table(spark, folder, "pages").select((-F.col("page_id") - 1).alias("trace_id"), N.metadata_flag("url", "html").alias("flagged"))
    return att.unionByName(pages)


@query("quarantine_invalid")
def quarantine_invalid(spark, folder):
    odd = (F.col("conv_id") * 3 + F.col("turn")) % 7
    rows = tables.fx_messages(spark, folder).select(
        "conv_id", "turn", F.when(odd == 1, "robot").otherwise(F.col("role")).alias("role"),
        F.when(odd == 2, "").when(odd == 3, F.repeat("content", 400)).otherwise(F.col("content")).alias("content"))
    ok, bad = N.validate(rows)
    kept = N.within_request_limit(rows, rows)
    return (ok.groupBy(F.lit("accepted").alias("verdict")).agg(F.count(F.lit(1)).alias("messages"))
            .unionByName(bad.groupBy(F.col("reject_reason").alias("verdict")).agg(F.count(F.lit(1)).alias("messages")))
            .unionByName(kept.groupBy(F.lit("in_valid_request").alias("verdict")).agg(F.count(F.lit(1)).alias("messages"))))


@query("sanitize_text")
def sanitize_text(spark, folder):
    return tables.fx_messages(spark, folder).select("conv_id", "turn", T.sanitized(F.col("content")).alias("sanitized"))


@query("retrieval_query_text")
def retrieval_query_text(spark, folder):
    return N.last_user_texts(normed(spark, folder))


@query("join_role_text")
def join_role_text(spark, folder):
    m = N.normalize(N.sized(tables.fx_messages(spark, folder)))
    return N.role_texts(N.within_request_limit(m, tables.fx_messages_stored(spark, folder)))


# --- input threat scan ----------------------------------------------------

def _family_query(family):
    def run(spark, folder):
        msgs = normed(spark, folder)
        if family is C.UNICODE_TRICKS:
            msgs = marked(msgs)
        return scan.signals_long(msgs, families=(family,), nested=False)
    return run


def marked(msgs):
    """Messages with zero-width, Arabic, override or combining characters by key arithmetic."""
    n = F.col("conv_id") % 6
    tail = (F.when(n == 0, "\u200b").when(n == 1, "\u0621").when(n == 2, "\u202e").when(n == 3, "e\u0301").otherwise(""))
    return msgs.withColumn("content", F.concat("content", tail))


for _family in C.FAMILIES:
    query(f"scan_{_family.key}")(_family_query(_family))


@query("scan_nested_encoding")
def scan_nested_encoding(spark, folder):
    msgs = tables.table(spark, folder, "conversations")
    b64 = lambda c: F.replace(F.base64(F.encode(c, "UTF-8")), F.lit("\r\n"), F.lit(""))
    n = (F.col("conv_id") + F.col("turn")) % 4
    text = F.col("text")
    wrapped = msgs.withColumn("content", F.when(n == 0, b64(text)).when(n == 1, b64(b64(text)))
                              .when(n == 2, F.hex(F.encode(b64(text), "UTF-8"))).otherwise(text))
    return scan.encoding_depth(wrapped).select("conv_id", "turn", "nested_depth",
                                               (F.col("nested_depth") >= C.NESTED_MIN_LAYERS).alias("signal"))


@query("signals_long")
def signals_long(spark, folder):
    return scan.signals_long(normed(spark, folder))


@query("input_scan_rollup")
def input_scan_rollup(spark, folder):
    r = scan.rollup(normed(spark, folder), "conv_id")
    return r.select("conv_id", "input_score", csv("input_labels").alias("input_labels"), "signal_count")


@query("signal_prefilter")
def signal_prefilter(spark, folder):
    flagged = scan.family_prefilter(normed(spark, folder))
    hits = scan.with_lowered(flagged).withColumns({f"hit_{f.key}": scan.family_hit(f) for f in C.FAMILIES})
    counts = hits.agg(*[F.count_if(f"may_{f.key}").alias(f"may_{f.key}") for f in C.FAMILIES],
                      *[F.count_if(f"hit_{f.key}").alias(f"hit_{f.key}") for f in C.FAMILIES],
                      *[F.count_if(~F.col(f"may_{f.key}") & F.col(f"hit_{f.key}")).alias(f"lost_{f.key}") for f in C.FAMILIES])
    return counts.select(F.explode(F.array(*[F.struct(
        F.lit(f.key).alias("family"), F.col(f"may_{f.key}").alias("may_hit"), F.col(f"hit_{f.key}").alias("hits"),
        F.col(f"lost_{f.key}").alias("lost")) for f in C.FAMILIES])).alias("x")).select("x.*")


# --- DLP and redaction ----------------------------------------------------

@query("dlp_matches")
def dlp_matches(spark, folder):
    return dlp.matches(normed(spark, folder))


@query("dlp_evidence")
def dlp_evidence(spark, folder):
    return dlp.matches(normed(spark, folder), preview=True)


@query("dlp_metadata_injection")
def dlp_metadata_injection(spark, folder):
    att = tables.fx_attachments(spark, folder).withColumn("meta", dlp.metadata_text("name", "content_type", "uri"))
    return dlp.matches(att, "meta", ["trace_id"], C.METADATA_DETECTORS)


@query("dlp_attachment_content")
def dlp_attachment_content(spark, folder):
    att = dlp.matches(tables.fx_attachments(spark, folder), "att_text", ["conv_id", "turn"]).withColumn("origin", F.lit("attachment"))
    msg = dlp.matches(normed(spark, folder)).withColumn("origin", F.lit("message"))
    return msg.unionByName(att).drop("matched")


@query("dlp_rollup")
def dlp_rollup(spark, folder):
    r = dlp.rollup(normed(spark, folder), "conv_id")
    return r.withColumn("dlp_labels", csv("dlp_labels"))


@query("redact_pii")
def redact_pii(spark, folder):
    docs = tables.table(spark, folder, "documents").select((-F.col("doc_id") - 1).alias("id"), F.col("text").alias("content"))
    msgs = normed(spark, folder).select((F.col("conv_id") * 1_000_000 + F.col("turn")).alias("id"), "content")
    return redact.redact(msgs.unionByName(docs), "content", "redacted", "replacements").select("id", "redacted", "replacements")


@query("redact_secrets_output")
def redact_secrets_output(spark, folder):
    return tables.fx_responses(spark, folder).select("trace_id", redact.redact_output(F.col("output_text")).alias("redacted"))


@query("redact_prompt_leak")
def redact_prompt_leak(spark, folder):
    return tables.fx_responses(spark, folder).select("trace_id", redact.redact_leaks(F.col("output_text")).alias("redacted"))


@query("residual_check")
def residual_check(spark, folder):
    done = redact.redact(normed(spark, folder), "content", rules=C.OUTPUT_REWRITES).select(*KEYS, "content")
    return redact.residual(done, "content", KEYS).withColumn("residual_patterns", csv("residual_patterns"))


@query("failsafe_redact")
def failsafe_redact(spark, folder):
    return redact.failsafe(normed(spark, folder), "content").select(*KEYS, "content", "residual_count", "was_redacted")


@query("redaction_counts")
def redaction_counts(spark, folder):
    parts = [normed(spark, folder).select(F.lit("message").alias("kind"), "content", (F.col("role") == "system").alias("skip")),
             tables.fx_attachments(spark, folder).select(F.lit("attachment").alias("kind"), F.col("att_text").alias("content"), F.lit(False).alias("skip")),
             tables.fx_chunks(spark, folder).select(F.lit("chunk").alias("kind"), F.col("chunk_text").alias("content"), F.lit(False).alias("skip"))]
    rows = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return redact.redaction_counts(rows, "kind", "content", F.col("skip"))


@query("dlp_corpus_profile")
def dlp_corpus_profile(spark, folder):
    return dlp.corpus_profile(tables.table(spark, folder, "documents"), ["source", "lang"])
