"""Content classification as one ordered CASE over request features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions.cache import remember

_ATTACK = ("prompt_injection", "jailbreak_attempt", "secret_exfiltration", "exploit_intent")


def has(labels: str, *names: str) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [F.array_contains(labels, n) for n in names]), F.lit(False))


def _verdict(label, confidence, reason) -> Column:
    as_col = lambda v: v if isinstance(v, Column) else F.lit(v)
    reasons = reason if isinstance(reason, Column) else F.array(F.lit(reason))
    return F.struct(as_col(label).alias("label"), as_col(confidence).cast("double").alias("confidence"), reasons.alias("reasons"))


def deterministic_rules() -> list[tuple[Column, tuple[str, float, str]]]:
    c = F.col
    elevated = c("risk_state").isin("elevated", "restricted")
    return [
        (has("input_labels", "prompt_leakage"), ("prompt_injection", 0.95, "prompt_leakage_signal")),
        (has("input_labels", "prompt_injection"), ("prompt_injection", 0.90, "prompt_injection_signal")),
        (has("input_labels", "jailbreak_attempt"), ("jailbreak_attempt", 0.90, "jailbreak_attempt_signal")),
        (has("input_labels", "secret_exfiltration"), ("secret_exfiltration_intent", 0.95, "secret_exfiltration_signal")),
        (has("input_labels", "exploit_intent"), ("exploit_or_malware_intent", 0.90, "exploit_intent_signal")),
        (has("dlp_labels", "secret", "financial"), ("sensitive_data_submission", 0.88, "sensitive_content_detected")),
        (c("input_score") >= 50, ("jailbreak_attempt", 0.80, "high_input_scan_score")),
        ((c("input_score") >= 20) | (c("dlp_score") >= 20) | elevated, ("suspicious", 0.65, "elevated_heuristic_signals")),
    ]


@remember
def _waterfall(prefix: str | None = None) -> Column:
    """The deterministic chain; a ``prefix`` reason goes before its own."""
    with_prefix = lambda reason: F.array(F.lit(prefix), F.lit(reason)) if prefix else reason
    chain = None
    for test, (label, confidence, reason) in deterministic_rules():
        value = _verdict(label, confidence, with_prefix(reason))
        chain = F.when(test, value) if chain is None else chain.when(test, value)
    # the benign answer carries its own reason only
    return chain.otherwise(_verdict("benign", 0.90, "no_material_risk_signals"))


def classify(df: DataFrame) -> DataFrame:
    return _spread(df.withColumn("_c", _waterfall()))


def _spread(df: DataFrame) -> DataFrame:
    return (df.withColumn("label", F.col("_c.label")).withColumn("confidence", F.col("_c.confidence"))
            .withColumn("reasons", F.col("_c.reasons")).drop("_c"))


def classify_with_guard(df: DataFrame) -> DataFrame:
    """Merge the guard model's verdict (``guard_*`` columns, null when absent) with the signals."""
    c = F.col
    present = c("guard_label").isNotNull()
    sensitive = has("dlp_labels", "secret", "pii", "financial")
    hard = c("guard_label").isin(*C.HARD_ATTACK_LABELS)
    sure = c("guard_confidence") >= 0.75
    corroborated = has("input_labels", *_ATTACK) | (c("input_score") >= 50)
    high_risk = ((c("input_score") >= 50) | (c("dlp_score") >= 40)
                 | has("input_labels", "prompt_injection", "jailbreak_attempt", "secret_exfiltration"))
    conflict = (present & c("guard_action").isin("allow", "allow_with_restrictions")
                & high_risk & (c("guard_confidence") < 0.95))
    submission = (present & (c("guard_label") == "secret_exfiltration_intent")
                  & ~has("input_labels", *_ATTACK) & sensitive)
    unconfirmed = present & hard & sure & ~corroborated
    unconfirmed_reason = "llm_guard_unconfirmed_by_deterministic_signals"
    accepted = present & (hard | (c("guard_label") == "sensitive_data_submission")) & sure
    verdict = (
        F.when(submission, _verdict("sensitive_data_submission", F.least(F.lit(0.90), c("guard_confidence")),
                                    "secret_submission_without_exfiltration_request"))
        .when(unconfirmed & sensitive, _verdict("sensitive_data_submission", 0.80, unconfirmed_reason))
        .when(unconfirmed, _verdict("suspicious", 0.70, unconfirmed_reason))
        .when(conflict, _waterfall("llm_guard_conflict_with_deterministic"))
        .when(accepted, _verdict(c("guard_label"), c("guard_confidence"), c("guard_reasons")))
        .otherwise(_waterfall()))
    df = df.withColumn("guard_confidence_adjusted", F.when(conflict & ~submission & ~unconfirmed, F.lit(0.3)))
    return _spread(df.withColumn("_c", verdict))


def class_features(df: DataFrame) -> DataFrame:
    """The features record kept with each verdict."""
    return df.withColumn("features", F.struct(
        c_("input_score"), c_("dlp_score"), c_("risk_score"), c_("risk_state"),
        F.array_sort("input_labels").alias("input_labels"), F.array_sort("dlp_labels").alias("dlp_labels"),
        c_("guard_label"), c_("guard_confidence"), c_("guard_risk"), c_("guard_confidence_adjusted")))


c_ = F.col
