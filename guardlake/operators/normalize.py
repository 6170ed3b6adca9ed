"""Message normalisation, validation and request facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import dialect as X
from guardlake.functions import text as T
from guardlake.operators.running import joined, running_counts


def normalize(messages: DataFrame, text: str = "content") -> DataFrame:
    """Control characters out, line ends unified, stripped; flag and length beside it."""
    return (messages
            .withColumn("has_control_chars", T.has_control_chars(F.col(text)))
            .withColumn(text, T.normalized(F.col(text)))
            .withColumn("content_length", F.char_length(text))
            .withColumn("source_label", T.trust_label(F.col("role"))))


def metadata_flag(*fields: str) -> Column:
    """True if any of the fields carries markup or code."""
    pattern = X.any_of(C.ATTACHMENT_FLAGS)
    return reduce(lambda a, b: a | b, [F.coalesce(F.lower(f).rlike(pattern), F.lit(False)) for f in fields])


def request_facts(messages: DataFrame, attachments: DataFrame, key: str = "conv_id") -> DataFrame:
    """Message and attachment facts per request, from two partial aggregations."""
    facts = messages.groupBy(key).agg(
        F.count(F.lit(1)).alias("message_count"),
        F.coalesce(F.bool_or(F.col("role") == "system"), F.lit(False)).alias("has_system_messages"),
        F.coalesce(F.bool_or(F.col("role") == "developer"), F.lit(False)).alias("has_developer_messages"))
    flagged = attachments.groupBy(key).agg(
        F.count(F.lit(1)).alias("attachment_count"),
        F.count_if(metadata_flag("name", "content_type", "uri")).alias("metadata_injection_count"))
    return (facts.join(flagged, key, "left")
            .withColumn("attachment_count", F.coalesce("attachment_count", F.lit(0)))
            .withColumn("metadata_injection_count", F.coalesce("metadata_injection_count", F.lit(0)))
            .withColumn("metadata_injection_detected", F.col("metadata_injection_count") > 0))


def reject_reason(role: str = "role", text: str = "content") -> Column:
    """Why a message is not accepted; null when it is."""
    return (F.when(F.col(role).isNull() | ~F.col(role).isin(*C.ROLES), "unknown_role")
            .when(F.coalesce(F.char_length(text), F.lit(0)) < C.MIN_CONTENT, "content_too_short")
            .when(F.char_length(text) > C.MAX_CONTENT, "content_too_long"))


def validate(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted messages and the quarantine with a reason."""
    marked = messages.withColumn("reject_reason", reject_reason())
    return (marked.filter(F.col("reject_reason").isNull()).drop("reject_reason"),
            marked.filter(F.col("reject_reason").isNotNull()))


TURNS_PER_BLOCK = 64


def _weight(text: str) -> Column:
    """Bytes a message adds; a message that is not accepted sinks its request."""
    return F.when(reject_reason("role", text).isNull(), F.octet_length(text)).otherwise(C.MAX_REQUEST_BYTES + 1)


def within_request_limit(rows: DataFrame, raw: DataFrame, text: str = "content") -> DataFrame:
    """Keep turns whose request (turns 0..t) is valid and within the byte limit.

    ``rows`` may be narrow (features only); ``raw`` is the message table the
    sizes come from.  A conversation of any length is cut into blocks of turns:
    block sizes are pre-aggregated, their prefix sums run over one small row per
    block, and the rows meet them by (conversation, block), so no task holds a
    whole long conversation.  What is left per conversation is at most the byte
    limit, which bounds every later window and text assembly on it.
    """
    block = F.floor(F.col("turn") / TURNS_PER_BLOCK).alias("blk")
    sized = raw.select("conv_id", "turn", block, _weight(text).cast("long").alias("bytes"))
    upto = Window.partitionBy("conv_id").orderBy("blk").rowsBetween(Window.unboundedPreceding, -1)
    before = (sized.groupBy("conv_id", "blk").agg(F.sum("bytes").alias("blk_bytes"))
              .withColumn("before", F.coalesce(F.sum("blk_bytes").over(upto), F.lit(0)))
              .filter(F.col("before") <= C.MAX_REQUEST_BYTES)
              .select("conv_id", "blk", "before"))
    local = Window.partitionBy("conv_id", "blk").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    if "bytes" not in rows.columns:
        rows = rows.withColumn("bytes", _weight(text).cast("long"))
    return (joined(rows.withColumn("blk", F.floor(F.col("turn") / TURNS_PER_BLOCK)), before, ["conv_id", "blk"])
            .withColumn("request_bytes", F.col("before") + F.sum("bytes").over(local))
            .filter(F.col("request_bytes") <= C.MAX_REQUEST_BYTES)
            .drop("blk", "before", "bytes"))


def rejected_requests(messages: DataFrame, text: str = "content") -> DataFrame:
    """Requests (user turns with all turns before them) that are not served, and why: the counterpart of ``within_request_limit``."""
    rows = messages.select("conv_id", "turn", "role", F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"),
                           reject_reason("role", text).isNotNull().cast("long").alias("bad"))
    run = running_counts(rows, ["conv_id"], ["turn"], "turn", {"bytes_before": F.col("bytes"), "bad_before": F.col("bad")}, slot_us=TURNS_PER_BLOCK)
    why = (F.when(F.col("bad_before") + F.col("bad") > 0, "invalid_message")
           .when(F.col("bytes_before") + F.col("bytes") > C.MAX_REQUEST_BYTES, "too_large"))
    return run.filter("role = 'user'").select("conv_id", "turn", why.alias("reject_reason")).filter("reject_reason IS NOT NULL")


def sized(messages: DataFrame, text: str = "content") -> DataFrame:
    """Add the byte weight while the text is still there."""
    return messages.withColumn("bytes", _weight(text).cast("long"))


def last_user_texts(messages: DataFrame, key: str = "conv_id", n: int = 3) -> DataFrame:
    """Retrieval query of each request: its last n user messages in order, joined by line feeds."""
    upto = Window.partitionBy(key).orderBy("turn")
    last = F.array_compact(F.array(*[F.lag("content", i).over(upto) for i in range(n - 1, 0, -1)], F.col("content")))
    return (messages.filter(F.col("role") == "user")
            .select(key, "turn", last.alias("last")).select(key, "turn", T.strip(F.array_join("last", "\n")).alias("query_text")))


def role_texts(messages: DataFrame, key: str = "conv_id") -> DataFrame:
    """Per request and role: sanitised non-blank contents joined by a blank line.

    Feed it turns that passed ``within_request_limit``: a group is then at most
    the byte limit of one request.
    """
    shown = (messages.filter(T.strip(F.col("content")) != "")
             .select(key, "role", "turn", T.sanitized(F.col("content")).alias("content")))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda s: s["content"])
    return shown.groupBy(key, "role").agg(
        F.array_join(parts, "\n\n").alias("role_text"), F.count(F.lit(1)).alias("message_count"))
