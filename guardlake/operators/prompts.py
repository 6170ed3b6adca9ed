"""Prompt assembly under a budget: sections, rendering, integrity, truncation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import dialect as X
from guardlake.functions import text as T
from guardlake.functions.rows import exploded, posexploded
from guardlake.operators import redact as R

_bullets = lambda lines: "\n".join(f"- {line}" for line in lines)


def policy_block(mode: str = "response_mode") -> Column:
    guarded = C.POLICY_LINES + C.GUARDED_LINES
    return (F.when(F.col(mode) == "restricted", _bullets(guarded + C.RESTRICTED_LINES))
            .when(F.col(mode) == "guarded", _bullets(guarded)).otherwise(_bullets(C.POLICY_LINES)))


def task_block(mode: str = "response_mode") -> Column:
    return (F.when(F.col(mode) == "restricted", C.TASK_TEXT["restricted"])
            .when(F.col(mode) == "guarded", C.TASK_TEXT["guarded"]).otherwise(C.TASK_TEXT["normal"]))


def retrieval_lines(chunks: DataFrame, key: str = "trace_id") -> DataFrame:
    """Retrieved-context block per request from its top-k chunks (so at most k rows a group)."""
    head = F.concat(F.lit("[chunk_id="), F.col("chunk_id"), F.lit(" doc_id="), F.col("document_id"),
                    F.lit(" sensitivity="), F.col("sensitivity"), F.lit(" trust="), F.col("trust_level"),
                    F.lit(" score="), F.col("score").cast("string"), F.lit("]"))
    block = F.concat(head, F.lit("\n"), T.sanitized(F.col("chunk_text")), F.lit("\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("rank", block.alias("t")))), lambda s: s["t"])
    return chunks.groupBy(key).agg(T.strip(F.array_join(parts, "\n")).alias("retrieval_block"))


def attachment_lines(attachments: DataFrame, key: str = "trace_id") -> DataFrame:
    line = F.concat_ws(", ", *[F.concat(F.lit(f"{'- ' if i == 0 else ''}{label}="), F.coalesce(F.col(col).cast("string"), F.lit("None")))
                               for i, (label, col) in enumerate((("name", "name"), ("content_type", "content_type"),
                                                                 ("size_bytes", "size_bytes"), ("source", "source"),
                                                                 ("trust", "source_label")))])
    parts = F.transform(F.array_sort(F.collect_list(F.struct("att_pos", line.alias("t")))), lambda s: s["t"])
    return attachments.groupBy(key).agg(F.array_join(parts, "\n").alias("attachment_block"))


def history_texts(turns: DataFrame) -> DataFrame:
    """User and assistant text of every request (turns 0..t), one row per user turn.

    Needs turns kept by ``within_request_limit``: the running lists of one
    conversation then hold at most the byte limit.
    """
    upto = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    shown = F.when(T.strip(F.col("content")) != "", T.sanitized(F.col("content")))
    turns = turns.withColumn("shown", shown)
    joined = lambda role: F.array_join(F.collect_list(F.when(F.col("role") == role, F.col("shown"))).over(upto), "\n\n")
    return (turns.withColumn("user_input", joined("user")).withColumn("assistant_history", joined("assistant"))
            .filter(F.col("role") == "user").drop("shown", "content"))


def sections(df: DataFrame, keys: list[str]) -> DataFrame:
    """Ordered, non-empty sections, one row each, from ``response_mode``, ``retrieval_block``,
    ``assistant_history``, ``user_input`` and ``attachment_block``."""
    filled = lambda col: F.coalesce(F.col(col), F.lit("")) != ""
    parts = [
        (F.lit(True), policy_block()),
        (F.lit(True), task_block()),
        (filled("retrieval_block"), F.col("retrieval_block")),
        (filled("assistant_history") & (F.coalesce(F.col("response_mode"), F.lit("normal")) != "restricted"), F.col("assistant_history")),
        (filled("user_input"), F.col("user_input")),
        (filled("attachment_block"), F.col("attachment_block")),
    ]
    built = F.array_compact(F.array(*[
        F.when(test, F.struct(F.lit(name).alias("name"), F.lit(trust).alias("trust_level"), content.alias("section_text")))
        for (name, trust), (test, content) in zip(C.SECTIONS, parts)]))
    return (posexploded(df, keys, built, "section_pos", "s")
            .select(*keys, "section_pos", F.col("s.name").alias("section_name"), "s.trust_level", "s.section_text"))


def render(section_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Prompt text from its sections (at most six rows a request)."""
    block = F.concat(F.lit("["), F.col("section_name"), F.lit("]\n"), F.col("section_text"),
                     F.lit("\n[/"), F.col("section_name"), F.lit("]\n"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("section_pos", block.alias("t")))), lambda s: s["t"])
    return section_rows.groupBy(*keys).agg(T.strip(F.array_join(parts, "\n")).alias("prompt_text"),
                                           F.count(F.lit(1)).alias("section_count"))


def budgeted(prompts: DataFrame, max_chars: int = C.MAX_PROMPT_CHARS) -> DataFrame:
    return (prompts.withColumn("prompt_chars", F.char_length("prompt_text"))
            .withColumn("token_estimate", T.token_estimate(F.col("prompt_text")))
            .withColumn("token_budget_exceeded", F.col("prompt_chars") > max_chars))


def fit_budget(section_rows: DataFrame, keys: list[str], max_chars: int = C.MAX_PROMPT_CHARS) -> DataFrame:
    """Mark which sections stay when the lowest-trust ones are dropped first.

    Dropping goes from least trusted to most, in section order within a level,
    so what stays is a suffix of that order; its rendered length is a running
    sum over at most six rows: two name lines, the content and five line breaks
    and brackets per section, less the stripped tail.
    """
    size = 2 * F.char_length("section_name") + F.char_length("section_text") + 9
    trust = T.rank(F.col("trust_level"), C.TRUST_RANK)
    kept_if_first = (Window.partitionBy(*keys).orderBy(F.desc("_trust"), "section_pos")
                     .rowsBetween(0, Window.unboundedFollowing))
    sized = section_rows.withColumn("_trust", trust).withColumn("_size", size)
    return (sized.withColumn("suffix_chars", F.sum("_size").over(kept_if_first) - 2)
            .withColumn("kept", F.col("suffix_chars") <= max_chars).drop("_trust", "_size"))


def truncated(section_rows: DataFrame, prompts: DataFrame, keys: list[str], max_chars: int = C.MAX_PROMPT_CHARS) -> DataFrame:
    """Prompts over budget rendered from the sections that fit, most trusted first; where none fits, cut off at the budget.

    ``prompts`` has ``prompt_text``; adds ``truncated`` and ``forced_slice`` and estimates anew.
    """
    fitting = fit_budget(section_rows, keys, max_chars).filter("kept")
    ordered = fitting.withColumn("section_pos", T.rank(F.col("trust_level"), C.TRUST_RANK) * len(C.SECTIONS) + F.col("section_pos"))
    kept = render(ordered, keys).select(*keys, F.col("prompt_text").alias("_kept"))
    over = F.char_length("prompt_text") > max_chars
    rows = prompts.join(kept, keys, "left").withColumn("truncated", over).withColumn("forced_slice", over & F.col("_kept").isNull())
    text = F.when(F.col("truncated"), F.coalesce("_kept", F.substring("prompt_text", 1, max_chars))).otherwise(F.col("prompt_text"))
    return budgeted(rows.withColumn("prompt_text", text).drop("_kept"), max_chars)


def budget_outcome(prompts: DataFrame, enforce: Column, mode: str = "block") -> DataFrame:
    """What happens to a prompt over budget: nothing unless enforced, then truncate or block."""
    over = F.col("token_budget_exceeded") & enforce
    return prompts.withColumn("budget_outcome", F.when(~over, "ok")
                              .otherwise("truncate" if mode == "truncate" else "block"))


def integrity(section_rows: DataFrame, keys: list[str]) -> DataFrame:
    """Violations, one row each: trust order, sensitive words in trusted text, contradictions."""
    order = Window.partitionBy(*keys).orderBy("section_pos")
    ranked = section_rows.withColumn("_t", T.rank(F.col("trust_level"), C.TRUST_RANK, 3))
    ranked = ranked.withColumn("_before", F.lag("_t").over(order))
    text, trusted = F.col("section_text"), F.col("trust_level") == "trusted"
    row_checks = [F.when(F.col("_t") < F.col("_before"),
                         F.struct(F.lit("trust_level_ordering").alias("kind"), F.lit("").alias("rule"), F.col("section_name").alias("where")))]
    row_checks += [F.when(trusted & text.rlike(X.java(p, True)),
                          F.struct(F.lit("sensitive_keyword_in_trusted").alias("kind"), F.lit(p).alias("rule"), F.col("section_name").alias("where")))
                   for p in C.TRUSTED_KEYWORDS]
    per_row = (exploded(ranked, keys, F.array_compact(F.array(*row_checks)), "v")
               .select(*keys, "v.kind", "v.rule", "v.where"))
    flags = section_rows.groupBy(*keys).agg(*[
        F.bool_or(test & text.rlike(X.java(p, True))).alias(f"{side}{i}")
        for i, pair in enumerate(C.CONTRADICTIONS)
        for side, p, test in (("t", pair[0], trusted), ("u", pair[1], ~trusted))])
    crossed = F.array_compact(F.array(*[F.when(F.col(f"t{i}") & F.col(f"u{i}"), F.lit(pair[0])) for i, pair in enumerate(C.CONTRADICTIONS)]))
    across = (exploded(flags, keys, crossed, "rule")
              .select(*keys, F.lit("contradiction_detected").alias("kind"), "rule", F.lit("").alias("where")))
    return per_row.unionByName(across)


def redact_sections(section_rows: DataFrame, mode: str = "regex") -> DataFrame:
    """``regex`` redacts each section and counts; the other modes leave texts that are
    treated elsewhere (``pre_redacted``, ``elsewhere``) as they are."""
    if mode == "regex":
        return R.redact(section_rows, "section_text", count="replacements")
    if mode not in ("pre_redacted", "elsewhere"):
        raise ValueError(f"unknown redaction mode {mode}")
    return section_rows.withColumn("replacements", F.lit(0))


def hybrid_check(prompts: DataFrame, guard_label: str = "guard_label") -> DataFrame:
    """Residual sensitive matches in the prompt and the guard model's own personal-data signal."""
    signal = F.col(guard_label).isin("sensitive_data_submission", "secret_exfiltration_intent")
    return (R.with_residual_count(prompts, "prompt_text")
            .withColumn("hybrid_pii_check_passed", F.col("residual_count") == 0)
            .withColumn("llm_pii_signal_detected", F.coalesce(signal, F.lit(False))))


def usage_tokens(answer: str = "answer", prompt_tokens: str = "prompt_tokens") -> dict[str, Column]:
    done = F.when(F.coalesce(F.char_length(answer), F.lit(0)) == 0, 0).otherwise(T.token_estimate(F.col(answer)))
    return {"completion_tokens": done, "total_tokens": done + F.col(prompt_tokens)}
