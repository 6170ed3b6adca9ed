"""Queries over retrieval, tools, prompts and answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from guardlake.functions import crypto
from guardlake.functions import text as T
from guardlake.operators import dlp
from guardlake.operators import guard_model as G
from guardlake.operators import normalize as N
from guardlake.operators import output_guard as OG
from guardlake.operators import prompts as PR
from guardlake.operators import retrieval as R
from guardlake.operators import tools as TL
from guardlake.operators import vector_index as V
from guardlake.plans import flow
from guardlake.plans.registry import csv, query
from guardlake.sources import tables

SIGNING_KEY = "retrieval-demo-key"


# --- retrieval ------------------------------------------------------------

@query("retrieve_topk")
def retrieve_topk(spark, folder):
    return R.topk(tables.fx_candidates(spark, folder)).select("trace_id", "chunk_id", "score", "rank")


@query("retrieve_topk_cosine")
def retrieve_topk_cosine(spark, folder):
    """The same with scores worked out from the embeddings of the given pairs."""
    vectors = tables.table(spark, folder, "embeddings")
    pairs = tables.fx_candidates(spark, folder).drop("score")
    queries = (tables.fx_requests(spark, folder).select("trace_id", F.col("conv_id").alias("vec_id"))
               .join(vectors.select("vec_id", F.col("embedding").alias("query_vector")), "vec_id", "left").drop("vec_id"))
    chunks = vectors.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("chunk_vector"))
    scored = R.score_candidates(pairs, queries, chunks)
    return R.topk(scored.withColumn("score", F.round("score", 6))).select("trace_id", "chunk_id", "score", "rank")


def vectors_and_queries(spark, folder):
    """All vectors, and those whose id is divisible by 20 as queries."""
    vectors = tables.table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return vectors, vectors.filter("id % 20 = 0")


@query("retrieve_index")
def retrieve_index(spark, folder):
    """Nearest ten of each query through the index, with as many probes as a recall of 0.95 takes on a sample of queries."""
    vectors, queries = vectors_and_queries(spark, folder)
    index = V.build(vectors, V.fit(vectors))
    return V.search(index, queries, 10, V.probes_for(index, queries)).select("query_id", "id", "score", "rank")


@query("retrieve_index_exact")
def retrieve_index_exact(spark, folder):
    """The same with all cells probed."""
    vectors, queries = vectors_and_queries(spark, folder)
    return V.search(V.build(vectors, V.fit(vectors)), queries, 10).select("query_id", "id", "score", "rank")


def pairs_with_chunks(spark, folder):
    requests = tables.fx_requests(spark, folder).select("trace_id", "tenant_id")
    chunks = R.checked_chunks(tables.fx_chunks(spark, folder)).drop("chunk_text")
    return R.topk(tables.fx_candidates(spark, folder)).join(requests, "trace_id").join(chunks, "chunk_id")


@query("tenant_filter")
def tenant_filter(spark, folder):
    return pairs_with_chunks(spark, folder).select("trace_id", "chunk_id", "tenant_id", "chunk_tenant", R.tenant_ok().alias("tenant_ok"))


@query("sensitivity_filter")
def sensitivity_filter(spark, folder):
    ceilings = flow.decisions_of(spark, folder).select("trace_id", "max_context_sensitivity")
    pairs = pairs_with_chunks(spark, folder).join(ceilings, "trace_id", "left")
    return pairs.select("trace_id", "chunk_id", "sensitivity", "max_context_sensitivity", R.sensitivity_ok().alias("sensitivity_ok"))


@query("integrity_hash")
def integrity_hash(spark, folder):
    return tables.fx_chunks(spark, folder).select("chunk_id", R.hash_ok().alias("hash_ok"))


@query("integrity_hmac")
def integrity_hmac(spark, folder):
    signed = tables.fx_chunks(spark, folder).withColumn(
        "source_signature", F.when(F.col("chunk_id") % 3 == 0, crypto.hmac_sha256(F.col("chunk_text"), SIGNING_KEY))
        .when(F.col("chunk_id") % 3 == 1, "forged"))
    return signed.select("chunk_id", R.hmac_ok(SIGNING_KEY).alias("hmac_ok"))


@query("indirect_injection_filter")
def indirect_injection_filter(spark, folder):
    return tables.fx_chunks(spark, folder).filter(R.injection_free()).select("chunk_id", F.char_length("chunk_text").alias("chunk_chars"))


@query("retrieval_gate")
def retrieval_gate(spark, folder):
    policy = flow.decisions_of(spark, folder).select("trace_id", "allow_retrieval").filter(F.col("trace_id") % 10 != 4)
    return R.gate(tables.fx_requests(spark, folder).select("trace_id"), policy)


@query("retrieval_funnel")
def retrieval_funnel(spark, folder):
    decided = flow.kept_decisions(spark, folder)
    return R.funnel(decided, flow.guarded_candidates(spark, folder, decided))


@query("chunk_dlp")
def chunk_dlp(spark, folder):
    allowed = flow.guarded_candidates(spark, folder, flow.decisions_of(spark, folder)).filter("drop_reason IS NULL")
    r = R.chunk_dlp(allowed, tables.fx_chunks(spark, folder))
    return r.withColumn("dlp_labels", csv("dlp_labels"))


# --- tools ----------------------------------------------------------------

@query("tool_calls")
def tool_calls(spark, folder):
    calls = TL.tool_calls(flow.requested_calls(spark, folder))
    return calls.select("trace_id", "session_id", "call_pos", "tool_name", F.element_at("arguments", "query").alias("argument"))


def authorized(spark, folder):
    return flow.authorized_calls(spark, folder, flow.decisions_of(spark, folder).withColumn("disable_tools", F.col("disable_tools") & (F.col("trace_id") % 2 == 0))
                                 .withColumn("max_context_sensitivity", F.when(F.col("trace_id") % 2 == 0, F.col("max_context_sensitivity")).otherwise("restricted"))
                                 .withColumn("label", F.when(F.col("trace_id") % 4 == 1, "benign").otherwise(F.col("label"))))


@query("tool_decision")
def tool_decision(spark, folder):
    return authorized(spark, folder).select("trace_id", "call_pos", "tool_name", "decision", "allowed",
                                            F.element_at("sanitized_arguments", "query").alias("argument"))


@query("arg_injection")
def arg_injection(spark, folder):
    calls = TL.tool_calls(flow.requested_calls(spark, folder))
    return calls.select("trace_id", "call_pos", TL.arg_injection().alias("arg_injection"))


@query("arg_tool_chain")
def arg_tool_chain(spark, folder):
    calls = TL.tool_calls(flow.requested_calls(spark, folder))
    return calls.select("trace_id", "call_pos", TL.arg_chain().alias("arg_chain"))


@query("sanitize_args")
def sanitize_args(spark, folder):
    long = F.concat(F.lit("  "), F.repeat("tool_query", 100), F.lit("\x00 "))
    args = tables.fx_requests(spark, folder).select("trace_id", F.create_map(F.lit("query"), long).alias("arguments"))
    return args.select("trace_id", F.element_at(TL.sanitized_args(), "query").alias("argument"))


@query("tool_execution_records")
def tool_execution_records(spark, folder):
    r = TL.execution_records(authorized(spark, folder))
    return r.select("trace_id", "call_pos", "tool_name", "record_reason", "executed", F.element_at("record_arguments", "query").alias("argument"))


@query("tool_usage")
def tool_usage(spark, folder):
    passed = flow.decisions_of(spark, folder).filter(flow.passes()).select("trace_id")
    records = TL.execution_records(authorized(spark, folder)).join(passed, "trace_id", "left_semi")
    sessions = tables.fx_requests(spark, folder).select("trace_id", "session_id")
    return TL.tool_usage(records.join(sessions, "trace_id"))


# --- prompts --------------------------------------------------------------

def sections(spark, folder):
    return flow.prompt_sections(spark, folder, flow.kept_decisions(spark, folder))


@query("prompt_sections")
def prompt_sections(spark, folder):
    s = sections(spark, folder)
    return s.select("trace_id", "section_pos", "section_name", "trust_level", F.md5(F.encode("section_text", "UTF-8")).alias("text_md5"),
                    F.char_length("section_text").alias("text_chars"))


def prompts(spark, folder):
    return flow.prompts(spark, folder, flow.kept_decisions(spark, folder))


@query("prompt_render")
def prompt_render(spark, folder):
    return prompts(spark, folder).select("trace_id", "section_count", F.md5(F.encode("prompt_text", "UTF-8")).alias("prompt_md5"))


@query("token_estimate")
def token_estimate(spark, folder):
    return prompts(spark, folder).select("trace_id", "prompt_chars", "token_estimate", "token_budget_exceeded")


@query("budget_truncate")
def budget_truncate(spark, folder):
    return PR.fit_budget(sections(spark, folder), ["trace_id"], 1200).select("trace_id", "section_name", "suffix_chars", "kept")


@query("budget_outcome")
def budget_outcome(spark, folder):
    parts = sections(spark, folder)
    whole = PR.render(parts, ["trace_id"])
    said = PR.budget_outcome(PR.budgeted(whole, 1200), F.col("trace_id") % 2 == 0, "truncate").select(
        "trace_id", "prompt_chars", "token_budget_exceeded", "budget_outcome")
    short = PR.truncated(parts, whole, ["trace_id"], 1200).select("trace_id", F.col("prompt_text").alias("short"), "forced_slice")
    cut = F.col("budget_outcome") == "truncate"
    return said.join(short, "trace_id").select(
        "trace_id", "prompt_chars", "token_budget_exceeded", "budget_outcome", F.when(cut, F.col("forced_slice")).alias("forced_slice"),
        F.when(cut, F.md5(F.encode("short", "UTF-8"))).alias("truncated_md5"), F.when(cut, F.char_length("short")).alias("truncated_chars"))


@query("prompt_integrity")
def prompt_integrity(spark, folder):
    return PR.integrity(sections(spark, folder), ["trace_id"])


@query("prompt_redact_mode")
def prompt_redact_mode(spark, folder):
    return PR.redact_sections(sections(spark, folder), "regex").select(
        "trace_id", "section_name", "replacements", F.md5(F.encode("section_text", "UTF-8")).alias("text_md5"))


@query("hybrid_pii_check")
def hybrid_pii_check(spark, folder):
    guard = tables.fx_guard(spark, folder).select("trace_id", "guard_label")
    return PR.hybrid_check(prompts(spark, folder).join(guard, "trace_id", "left")).select(
        "trace_id", "residual_count", "hybrid_pii_check_passed", "llm_pii_signal_detected")


@query("usage_tokens")
def usage_tokens(spark, folder):
    asked = tables.fx_messages(spark, folder).filter("role = 'user'").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("trace_id"), T.token_estimate(F.col("content")).alias("prompt_tokens"))
    who = tables.fx_requests(spark, folder).select("trace_id", "tenant_id").join(
        tables.fx_guard(spark, folder).select("trace_id", "model"), "trace_id")
    answers = tables.fx_responses(spark, folder).select("trace_id", F.coalesce("output_text", F.lit("")).alias("answer"))
    rows = (asked.join(who, "trace_id").join(answers, "trace_id", "left").withColumn("answer", F.coalesce("answer", F.lit("")))
            .withColumns(PR.usage_tokens()))
    fine = rows.groupBy("tenant_id", "model").agg(F.count(F.lit(1)).alias("n"), F.sum("prompt_tokens").alias("p"),
                                                  F.sum("completion_tokens").alias("c"), F.sum("total_tokens").alias("t"))
    return fine.rollup("tenant_id", "model").agg(F.sum("n").alias("requests"), F.sum("p").alias("prompt_tokens"),
                                                 F.sum("c").alias("completion_tokens"), F.sum("t").alias("total_tokens"),
                                                 F.grouping_id().cast("int").alias("level"))


# --- answers --------------------------------------------------------------

@query("response_text")
def response_text(spark, folder):
    payload = tables.fx_responses(spark, folder).withColumn("payload", F.to_json(F.create_map("field", "output_text")))
    found = payload.withColumn("found_field", OG.response_field())
    return found.select("trace_id", "found_field", F.when(F.col("found_field") != "guarded_output", OG.response_text()).alias("text"))


@query("output_dlp")
def output_dlp(spark, folder):
    r = dlp.rollup(tables.fx_responses(spark, folder), "trace_id", "output_text")
    return r.withColumn("dlp_labels", csv("dlp_labels"))


@query("leak_signals")
def leak_signals(spark, folder):
    return tables.fx_responses(spark, folder).select("trace_id", csv(OG.leak_signals()).alias("leaks"))


def inspected(spark, folder):
    """Answers of requests that passed, against the prompt that was assembled for them."""
    return flow.inspected(spark, folder, prompts(spark, folder))


@query("length_anomaly")
def length_anomaly(spark, folder):
    return inspected(spark, folder).select("trace_id", "prompt_chars", F.char_length("output_text").alias("output_chars"), "anomaly")


@query("output_action")
def output_action(spark, folder):
    return inspected(spark, folder).select("trace_id", "output_action", csv("output_reasons").alias("output_reasons"),
                                           csv("output_signals").alias("output_signals"), "dlp_score", "redacted_text")


@query("apply_output")
def apply_output(spark, folder):
    return OG.apply_output(inspected(spark, folder)).select(
        "trace_id", "output_action", F.when(F.col("field") == "other", "guarded_output").otherwise(F.col("field")).alias("placed_in"), "client_text")


@query("guard_input_text")
def guard_input_text(spark, folder):
    turns = N.within_request_limit(N.normalize(N.sized(tables.fx_messages(spark, folder))), tables.fx_messages_stored(spark, folder))
    from pyspark.sql import Window
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    texts = F.array_join(F.collect_list(F.when(F.col("role") == "user", F.col("content"))).over(upto), "\n\n")
    cut = turns.withColumn("t", T.strip(texts)).filter("role = 'user' AND t <> ''").select(
        (F.col("conv_id") * 1_000_000 + F.col("turn")).alias("trace_id"), T.cut(F.col("t"), 500, "\n[TRUNCATED_FOR_GUARD]").alias("short"),
        G.guard_input_text(F.col("t")).alias("guard_text"))
    return cut
