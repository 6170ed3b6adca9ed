"""Rate limits and attacker profiles over a logged decision table."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.operators.running import running_counts, trailing_count

SECOND_US = 1_000_000
LIMIT_KEY = ["client_id", "subject"]


def sliding_hits(log: DataFrame, keys=LIMIT_KEY, window_s: int = C.RATE_WINDOW_S, row_id: str = "event_id",
                 name: str = "current_hits") -> DataFrame:
    """Earlier arrivals of the key in the trailing window (lower bound included)."""
    return trailing_count(log, list(keys), "us", row_id, window_s * SECOND_US, name)


def effective_limit(score: Column, injections: Column, multiplier: Column, base: int = C.RATE_LIMIT) -> Column:
    """Base limit, tightened by score, then by profile multiplier, then by repeated injections."""
    by_score = (F.when(score >= 80, max(1, base // 10)).when(score >= 50, max(1, base // 5))
                .when(score >= 30, max(1, base // 2)).otherwise(base))
    by_profile = F.when(multiplier > 1, F.greatest(F.lit(1), F.floor(by_score / multiplier).cast("int"))).otherwise(by_score)
    return F.when(injections == 2, F.greatest(F.lit(1), F.floor(by_profile / 2).cast("int"))).otherwise(by_profile)


def contains_any(code: Column, *words: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(code, F.lit(w)) for w in words])


def code_counts(codes: str = "reason_codes") -> dict[str, Column]:
    """What the reason codes of one refusal add to a profile."""
    n = lambda *words: F.size(F.filter(codes, lambda code: contains_any(code, *words)))
    return {
        "injection_attempts": n("INJECTION", "JAILBREAK"),
        "jailbreak_attempts": n("JAILBREAK"),
        "escalation_attempts": n("ESCALATION", "PRIVILEGE"),
        "tool_abuse_attempts": n("TOOL"),
    }


def multiplier(jailbreaks: Column, escalations: Column, injections: Column) -> Column:
    product = (F.when(jailbreaks >= 3, 5).otherwise(1) * F.when(escalations >= 2, 3).otherwise(1)
               * F.when(injections >= 5, 2).otherwise(1))
    return F.least(F.lit(20), product)


def with_prior_profile(log: DataFrame, row_id: str = "event_id", source: DataFrame | None = None) -> DataFrame:
    """Profile counts of the (client, subject) from refusals before each request."""
    denied = F.col("action") == "deny"
    add = {n: F.when(denied, c).otherwise(0) for n, c in code_counts().items()}
    return running_counts(log, LIMIT_KEY, ["us", row_id], "us", add, source=source)


def rate_verdict(log: DataFrame, row_id: str = "event_id") -> DataFrame:
    """Would-be verdict of each arrival if every arrival counted as a hit.

    Three passes over narrow rows: trailing hits and profile per (client,
    subject), injections per session.
    """
    denied = (F.col("action") == "deny").cast("int")
    rows = running_counts(log, ["session_id"], ["us", row_id], "us", {"injections_before": denied})
    rows = sliding_hits(with_prior_profile(rows, row_id, source=log), row_id=row_id)
    rows = rows.withColumn("limit_multiplier", multiplier(
        F.col("jailbreak_attempts"), F.col("escalation_attempts"), F.col("injection_attempts")))
    rows = rows.withColumn("effective_limit", effective_limit(
        F.col("input_score"), F.col("injections_before"), F.col("limit_multiplier")))
    return rows.withColumn("verdict", F.when(F.col("injections_before") >= 3, "aggressive_attacker_cooldown")
                           .when(F.col("current_hits") >= F.col("effective_limit"), "rate_limit_exceeded")
                           .otherwise("allowed"))


def profiles(denials: DataFrame) -> DataFrame:
    """One profile per (client, subject); reason codes are counted inside the row."""
    return (denials.select(*LIMIT_KEY, "us", *[c.alias(n) for n, c in code_counts().items()])
            .groupBy(*LIMIT_KEY).agg(
                F.min("us").alias("first_us"), F.max("us").alias("last_us"), F.count(F.lit(1)).alias("refusal_count"),
                *[F.sum(n).alias(n) for n in code_counts()]))


def top_reason(denials: DataFrame, row_id: str = "event_id", keep: int = C.REASON_HISTORY) -> DataFrame:
    """Most frequent of the last codes; a tie goes to the one that comes first in the kept list."""
    codes = denials.select(*LIMIT_KEY, "us", row_id, F.posexplode("reason_codes").alias("pos", "code"))
    newest = Window.partitionBy(*LIMIT_KEY).orderBy(F.desc("us"), F.desc(row_id), F.desc("pos"))
    kept = codes.withColumn("rn", F.row_number().over(newest)).filter(F.col("rn") <= keep)
    per_code = kept.groupBy(*LIMIT_KEY, "code").agg(F.count(F.lit(1)).alias("n"), F.max("rn").alias("oldest"))
    return per_code.groupBy(*LIMIT_KEY).agg(
        F.max_by("code", F.struct("n", "oldest")).alias("reason_cluster"), F.sum("n").alias("kept_codes"))


def suspicious(as_of_us: Column) -> Column:
    young = (F.col("refusal_count") >= 5) & (as_of_us - F.col("first_us") < 300 * SECOND_US)
    return (young | (F.col("jailbreak_attempts") >= 3) | (F.col("escalation_attempts") >= 2)
            | (F.col("tool_abuse_attempts") >= 5))


def alerts(profile_rows: DataFrame, as_of_us: Column, n: int = 100) -> DataFrame:
    """Newest suspicious profiles (a top-n report)."""
    return profile_rows.filter(suspicious(as_of_us)).orderBy(F.desc("last_us"), *LIMIT_KEY).limit(n)


def retain(profile_rows: DataFrame, n: int = C.MAX_PROFILES) -> DataFrame:
    """Keep the n profiles first seen last (the oldest are evicted)."""
    return profile_rows.orderBy(F.desc("first_us"), *LIMIT_KEY).limit(n)


def call_budget(calls: DataFrame, max_calls: int = C.GUARD_CALLS_PER_WINDOW, window_s: int = C.GUARD_CALL_WINDOW_S,
                row_id: str = "event_id") -> DataFrame:
    """Calls over the budget of the trailing window get the conservative answer.

    The budget is shared by all callers, so there is no key: time slots of a
    sixtieth of the window alone spread the rows.
    """
    counted = trailing_count(calls, [], "us", row_id, window_s * SECOND_US, "calls_before",
                             slot_us=max(1, window_s // 60) * SECOND_US)
    over = F.col("calls_before") >= max_calls
    return (counted.withColumn("over_budget", over)
            .withColumn("fallback_label", F.when(over, "suspicious"))
            .withColumn("fallback_confidence", F.when(over, F.lit(0.4)))
            .withColumn("fallback_risk", F.when(over, 35))
            .withColumn("fallback_action", F.when(over, "allow_with_restrictions"))
            .withColumn("fallback_reason", F.when(over, "llm_guard_rate_limited")))
