"""The guard pipeline from messages to decisions, as one lazy plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators import audit as A
from guardlake.operators import classify as K
from guardlake.operators import dlp
from guardlake.operators import limits as L
from guardlake.operators import normalize as N
from guardlake.operators import output_guard as OG
from guardlake.operators import policy as P
from guardlake.operators import prompts as PR
from guardlake.operators import redact as RD
from guardlake.operators import retrieval as R
from guardlake.operators import scan
from guardlake.operators import sessions as S
from guardlake.operators import tools as TL
from guardlake.sources import bundle, tables
from guardlake.spark import kept


def message_features(messages: DataFrame) -> DataFrame:
    """Narrow numeric features per message; the text is read once and dropped here."""
    df = scan.score_columns(scan.with_signals(N.normalize(N.sized(messages))))
    df = dlp.score_columns(dlp.with_counts(df))
    return df.select(
        "conv_id", "turn", "role", "bytes", "has_control_chars", "scan_points", "signal_count",
        *[f"is_{n}" for n in C.INPUT_LABELS], "dlp_points", "match_count", *[f"dlp_{n}" for n in C.DLP_LABELS])


def attachment_features(attachments: DataFrame) -> DataFrame:
    """DLP points and labels of each request's attachments: content and metadata."""
    both = dlp.with_counts(attachments, "att_text")
    both = both.withColumn("meta", dlp.metadata_text("name", "content_type", "uri"))
    both = dlp.with_counts(both, "meta", C.METADATA_DETECTORS)
    scored = dlp.score_columns(both, C.DETECTORS + C.METADATA_DETECTORS)
    return scored.groupBy("trace_id").agg(
        F.sum("dlp_points").alias("att_points"), F.count(F.lit(1)).alias("attachment_count"),
        *[F.max(f"dlp_{n}").alias(f"att_{n}") for n in C.DLP_LABELS])


def request_features(messages: DataFrame, requests: DataFrame, attachments: DataFrame,
                     stored: DataFrame | None = None) -> DataFrame:
    """Features of every request: request t of a conversation is its turns 0..t.

    Each message is scanned once; running sums and flags over the (bounded)
    conversation replace any join of turns with turns.  Capping after the sum
    equals the capped sum.
    """
    turns = N.within_request_limit(message_features(messages), messages if stored is None else stored)
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    flags = [*[f"is_{n}" for n in C.INPUT_LABELS], *[f"dlp_{n}" for n in C.DLP_LABELS]]
    running = turns.select(
        "conv_id", "turn", "role", "request_bytes",
        *[F.sum(n).over(upto).alias(n) for n in ("scan_points", "signal_count", "dlp_points", "match_count")],
        *[F.max(n).over(upto).alias(n) for n in flags],
        F.bool_or("has_control_chars").over(upto).alias("has_control_chars"),
        F.bool_or(F.col("role") == "system").over(upto).alias("has_system_messages"),
        F.bool_or(F.col("role") == "developer").over(upto).alias("has_developer_messages"),
        F.count(F.lit(1)).over(upto).alias("message_count"),
        F.count_if(F.col("role") == "user").over(upto).alias("request_count"))
    asked = running.filter(F.col("role") == "user").drop("role").join(requests, ["conv_id", "turn"])
    full = asked.join(attachment_features(attachments), "trace_id", "left")
    merged = {f"dlp_{n}": F.greatest(F.col(f"dlp_{n}"), F.coalesce(F.col(f"att_{n}"), F.lit(0))) for n in C.DLP_LABELS}
    full = full.withColumns(merged).withColumn("dlp_points", F.col("dlp_points") + F.coalesce("att_points", F.lit(0)))
    full = (full.withColumn("input_score", scan.capped("scan_points")).withColumn("dlp_score", scan.capped("dlp_points"))
            .withColumn("input_labels", scan.labels_from_flags(C.INPUT_LABELS))
            .withColumn("dlp_labels", scan.labels_from_flags(C.DLP_LABELS, "dlp_"))
            .withColumn("attachment_count", F.coalesce("attachment_count", F.lit(0)))
            .drop(*flags, *[f"att_{n}" for n in C.DLP_LABELS], "att_points", "scan_points", "dlp_points"))
    return full


def with_offline_risk(features: DataFrame) -> DataFrame:
    """Session risk from what the request table itself knows (no refusal feedback;
    ``streaming.state`` replays that exactly)."""
    zero = {n: F.lit(0) for n in ("refusal_count", "tool_request_count", "injection_attempt_count", "escalation_pattern_count")
            if n not in features.columns}
    return S.session_risk(features.withColumns(zero) if zero else features)


def decisions(features: DataFrame, rules=None) -> DataFrame:
    """Risk, classification and policy: narrow expressions plus one broadcast of the bundle."""
    return P.decide(K.classify(with_offline_risk(features)), rules or bundle.shipped())


def features_of(spark, folder: str) -> DataFrame:
    return request_features(tables.fx_messages(spark, folder), tables.fx_requests(spark, folder),
                            tables.fx_attachments(spark, folder), tables.fx_messages_stored(spark, folder))


def decisions_of(spark, folder: str) -> DataFrame:
    return decisions(features_of(spark, folder))


def kept_decisions(spark, folder: str) -> DataFrame:
    """Decisions as a written table, for plans that join them more than once."""
    return kept(decisions_of(spark, folder))


# --- after the policy: retrieval, tools, prompts, answers -------------------

def guarded_candidates(spark, folder: str, decided: DataFrame) -> DataFrame:
    """Top-k candidates of requests whose policy allows retrieval, each with its first failing check.

    Chunk checks run once per chunk, before the join.
    """
    best = R.topk(tables.fx_candidates(spark, folder))
    chunks = R.checked_chunks(tables.fx_chunks(spark, folder)).select(
        "chunk_id", "document_id", "chunk_tenant", "sensitivity", "trust_level", "integrity_ok", "injection_ok")
    open_ = decided.filter("allow_retrieval").select("trace_id", "tenant_id", "max_context_sensitivity")
    return R.with_drop_reason(best.join(open_, "trace_id").join(chunks, "chunk_id", "left"))


def retrieval_blocks(spark, folder: str, decided: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """``candidates``: those of ``guarded_candidates``, where they are at hand."""
    candidates = guarded_candidates(spark, folder, decided) if candidates is None else candidates
    allowed = candidates.filter(F.col("drop_reason").isNull())
    texts = tables.fx_chunks(spark, folder).select("chunk_id", "chunk_text")
    return PR.retrieval_lines(allowed.join(texts, "chunk_id"))


def prompt_sections(spark, folder: str, decided: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    """Sections of every request the policy lets through."""
    turns = N.within_request_limit(N.normalize(N.sized(tables.fx_messages(spark, folder))), tables.fx_messages_stored(spark, folder))
    history = PR.history_texts(turns).select("conv_id", "turn", "user_input", "assistant_history")
    passed = decided.filter(passes()).select("trace_id", "conv_id", "turn", "response_mode")
    full = (history.join(passed, ["conv_id", "turn"])
            .join(retrieval_blocks(spark, folder, decided, candidates), "trace_id", "left")
            .join(PR.attachment_lines(tables.fx_attachments(spark, folder)), "trace_id", "left"))
    return PR.sections(full, ["trace_id", "response_mode"])


def prompts(spark, folder: str, decided: DataFrame, candidates: DataFrame | None = None) -> DataFrame:
    return PR.budgeted(PR.render(prompt_sections(spark, folder, decided, candidates), ["trace_id", "response_mode"]))


def requested_calls(spark, folder: str) -> DataFrame:
    """Each request asks for its tool, and every third one asks twice with other words."""
    r = tables.fx_requests(spark, folder)
    one = F.struct(F.col("tool_name").alias("name"), F.create_map(F.lit("query"), F.col("tool_query")).alias("arguments"))
    two = F.struct(F.col("tool_name").alias("name"), F.create_map(F.lit("query"), F.lit(" plain ")).alias("arguments"))
    calls = F.when(F.col("trace_id") % 3 == 0, F.array(one, two)).otherwise(F.array(one))
    return r.select("trace_id", "session_id", F.to_json(calls).alias("requested_tools"))


def authorized_calls(spark, folder: str, decided: DataFrame) -> DataFrame:
    calls = TL.tool_calls(requested_calls(spark, folder))
    context = decided.select("trace_id", "action", "permissions", "disable_tools", "max_context_sensitivity", "label")
    return TL.authorize(calls.join(context, "trace_id"))


def inspected(spark, folder: str, prompt_facts: DataFrame) -> DataFrame:
    """Answers of passed requests with the output guard's decision."""
    sized = prompt_facts.select("trace_id", "response_mode", "prompt_chars")
    answers = (tables.fx_responses(spark, folder).select("trace_id", "output_text", "field").join(sized, "trace_id")
               .join(tables.fx_guard(spark, folder).drop("model"), "trace_id", "left"))
    return OG.output_action(OG.with_dlp(answers))


def rate_allowed(requests: DataFrame) -> DataFrame:
    """Offline verdict of each request: arrivals in the window against the limit that its score, earlier
    denials of its session and the profile of its (client, subject) leave."""
    timed = requests.select("trace_id", "session_id", "client_id", "subject", "input_score", "action", "reason_codes",
                            (F.col("ts_s") * 1_000_000).alias("us"))
    return L.rate_verdict(timed, row_id="trace_id").select("trace_id", (F.col("verdict") == "allowed").alias("rate_allowed"))


def passes() -> Column:
    """Whether the policy lets a request through to retrieval, tools, prompt and answer."""
    return ~F.col("action").isin("deny", "challenge")


ANSWER = ("output_action", "output_reasons", "output_signals")


def served_of(spark, folder: str) -> DataFrame:
    """One wide row per request: every decision and the outcome."""
    return _served(spark, folder, lambda df: df)[0]


def _served(spark, folder: str, hold) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The wide rows, and the candidates and inspected answers behind them, on which ``hold`` is used (``kept``, if they are read again)."""
    decided = kept_decisions(spark, folder)
    found = hold(guarded_candidates(spark, folder, decided))
    blocked = authorized_calls(spark, folder, decided).groupBy("trace_id").agg(
        F.count(F.lit(1)).alias("requested_tool_count"),
        F.array_sort(F.collect_set(F.when(passes() & ~F.col("allowed"), F.concat_ws(":", "tool_name", "decision")))).alias("blocked_tools"))
    facts = kept(RD.with_residual_count(prompts(spark, folder, decided, found), "prompt_text").drop("prompt_text"))
    prompt = facts.select("trace_id", "residual_count", "token_budget_exceeded")
    said = hold(inspected(spark, folder, facts).select("trace_id", *ANSWER))
    answers = said.select("trace_id", "output_action")
    wide = (decided.join(rate_allowed(decided), "trace_id").join(blocked, "trace_id", "left")
            .join(prompt, "trace_id", "left").join(answers, "trace_id", "left"))
    wide = wide.withColumns({
        "requested_tool_count": F.coalesce("requested_tool_count", F.lit(0)),
        "blocked_tools": F.coalesce("blocked_tools", F.array().cast("array<string>")),
        "residual_count": F.coalesce("residual_count", F.lit(0)),
        "budget_outcome": F.when(F.coalesce("token_budget_exceeded", F.lit(False)), "block").otherwise("ok")})
    return A.outcome(wide), found, said


def records_of(spark, folder: str) -> DataFrame:
    """The wide row with what each later stage decided: guard verdict, retrieval, tools, answer."""
    served, found, said = _served(spark, folder, kept)
    served = kept(served)
    repeated = kept(served.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("trace_id"))
    if repeated.take(1):  # stages after the wide row see a request as often as it has wide rows
        again = kept(served.join(repeated, "trace_id", "left_semi"))
        both = lambda df, more: df.join(repeated, "trace_id", "left_anti").unionByName(more)
        found = both(found, guarded_candidates(spark, folder, again))
        said = both(said, inspected(spark, folder, prompts(spark, folder, again)).select("trace_id", *ANSWER))
    candidates = found.groupBy("trace_id").agg(
        F.count_if(F.col("drop_reason").isNull()).alias("allowed_chunks"), F.count("drop_reason").alias("dropped_chunks"))
    # At most one entry per requested call of one request.
    calls = F.array_sort(F.collect_list(F.struct("call_pos", "tool_name", "decision")))
    tools = authorized_calls(spark, folder, served.filter(passes())).groupBy("trace_id").agg(calls.alias("tool_decisions"))
    answers = said.select("trace_id", "output_reasons", "output_signals")
    guard = tables.fx_guard(spark, folder).select("trace_id", "guard_label", "guard_confidence", "guard_risk", "guard_action")
    return (served.join(guard, "trace_id", "left").join(candidates, "trace_id", "left")
            .join(tools, "trace_id", "left").join(answers, "trace_id", "left"))


def outcomes_of(spark, folder: str) -> DataFrame:
    """Every request once: what stopped it, rejected ones included."""
    served = served_of(spark, folder).select("trace_id", "rate_allowed", "outcome", "status_code", F.lit(None).cast("string").alias("reject_reason"))
    rejected = N.rejected_requests(tables.fx_messages_stored(spark, folder)).join(tables.fx_requests(spark, folder), ["conv_id", "turn"])
    return served.unionByName(rejected.select(
        "trace_id", F.lit(None).cast("boolean").alias("rate_allowed"), F.lit("rejected").alias("outcome"),
        F.when(F.col("reject_reason") == "too_large", 413).otherwise(422).alias("status_code"), "reject_reason"))
