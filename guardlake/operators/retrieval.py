"""Retrieval guard: candidates, gates, integrity, indirect injection, funnel."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import crypto
from guardlake.functions import dialect as X
from guardlake.functions import text as T
from guardlake.operators import dlp


def cosine(a: str, b: str) -> Column:
    """Cosine of two float arrays, summed in double precision."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")),
                                   F.lit(0.0), lambda acc, v: acc + v)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def score_candidates(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """Score given (request, chunk) pairs; equi-joins only, never all pairs. A pair without a vector has no score and ranks last."""
    return (candidates.join(queries, "trace_id", "left").join(chunks, "chunk_id", "left")
            .withColumn("score", cosine("query_vector", "chunk_vector"))
            .drop("query_vector", "chunk_vector"))


def topk(candidates: DataFrame, k: int = C.RETRIEVAL_TOP_K, key: str = "trace_id") -> DataFrame:
    """Best k candidates per request; ties by chunk id.  The rank filter prunes before the shuffle."""
    best = Window.partitionBy(key).orderBy(F.desc_nulls_last("score"), "chunk_id")
    return candidates.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k)


def tenant_ok(request_tenant: str = "tenant_id", chunk_tenant: str = "chunk_tenant", strict: bool = False) -> Column:
    """A chunk passes unless both tenants are set and differ (strict: both set and equal)."""
    a, b = F.col(request_tenant), F.col(chunk_tenant)
    if strict:
        return F.coalesce(a == b, F.lit(False))
    either_blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return either_blank | (a == b)


def sensitivity_ok(sensitivity: str = "sensitivity", ceiling: str = "max_context_sensitivity") -> Column:
    limit = F.coalesce(F.col(ceiling), F.lit(C.DEFAULT_CEILING))
    return T.rank(F.col(sensitivity), C.SENSITIVITY_RANK) <= T.rank(limit, C.SENSITIVITY_RANK)


def hash_ok(text: str = "chunk_text", digest: str = "content_hash") -> Column:
    no_hash = F.coalesce(F.col(digest), F.lit("")) == ""
    return no_hash | (crypto.sha256_text(F.col(text)) == F.col(digest))


def hmac_ok(key: str, text: str = "chunk_text", signature: str = "source_signature") -> Column:
    if not key:
        return F.lit(True)
    unsigned = F.coalesce(F.col(signature), F.lit("")) == ""
    return unsigned | (crypto.hmac_sha256(F.col(text), key) == F.col(signature))


def injection_free(text: str = "chunk_text") -> Column:
    return ~F.lower(text).rlike(X.any_of(C.CHUNK_INJECTION))


def checked_chunks(chunks: DataFrame, key: str = "") -> DataFrame:
    """What depends on the chunk alone, worked out once per chunk before any join."""
    return chunks.withColumns({
        "integrity_ok": hash_ok() & (hmac_ok(key) if "source_signature" in chunks.columns else F.lit(True)),
        "injection_ok": injection_free()})


def gate(requests: DataFrame, policy: DataFrame) -> DataFrame:
    """Requests with ``retrieval_open``: false when the policy is absent or disallows retrieval."""
    return (requests.join(policy, "trace_id", "left")
            .withColumn("retrieval_open", F.coalesce(F.col("allow_retrieval"), F.lit(False))))


def with_drop_reason(pairs: DataFrame) -> DataFrame:
    """First failing check of each candidate; null when it is allowed. Without ``integrity_ok`` no stored chunk was found."""
    return pairs.withColumn("drop_reason", F.when(F.col("integrity_ok").isNull(), "missing").when(~tenant_ok(), "tenant")
                            .when(~sensitivity_ok(), "sensitivity")
                            .when(~F.col("integrity_ok"), "integrity")
                            .when(~F.col("injection_ok"), "injection"))


def funnel(requests: DataFrame, pairs: DataFrame, key: str = "trace_id") -> DataFrame:
    """Counts per request over candidates marked by ``with_drop_reason``; closed requests give zeros."""
    r = F.col("drop_reason")
    counts = pairs.groupBy(key).agg(
        F.count_if(r.isin("tenant", "sensitivity")).alias("filtered_out_count"),
        F.count_if(r == "missing").alias("missing_count"),
        F.count_if(r == "integrity").alias("integrity_filtered_count"),
        F.count_if(r == "injection").alias("injection_filtered_count"),
        F.count_if(r.isNull()).alias("allowed_count"))
    names = [c for c in counts.columns if c != key]
    return requests.select(key).join(counts, key, "left").na.fill(0, names)


def chunk_dlp(allowed: DataFrame, chunks: DataFrame, key: str = "trace_id") -> DataFrame:
    """DLP over the surviving chunks: each chunk is scanned once, however many requests cite it."""
    scored = dlp.score_columns(dlp.with_counts(chunks.select("chunk_id", "chunk_text"), "chunk_text")).drop("chunk_text")
    return dlp.combine(allowed.select(key, "chunk_id").join(scored, "chunk_id"), key)
