"""Answer inspection: leaks, secrets, length, action and final text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import dialect as X
from guardlake.operators import dlp
from guardlake.operators import redact as R
from guardlake.operators.scan import capped

FIELDS = ("answer", "message", "output_text")


def _string_field(payload: Column, name: str) -> Column:
    """The field's value if it is a JSON string, else null."""
    v = F.try_variant_get(F.try_parse_json(payload), "$." + name, "variant")
    return F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))


def response_field(payload: str = "payload") -> Column:
    """Name of the field the text was found in; ``guarded_output`` when none holds a string."""
    return F.coalesce(*[F.when(_string_field(F.col(payload), n).isNotNull(), n) for n in FIELDS], F.lit("guarded_output"))


def response_text(payload: str = "payload") -> Column:
    return F.coalesce(*[_string_field(F.col(payload), n) for n in FIELDS], F.col(payload))


def leak_signals(text: str = "output_text") -> Column:
    low = F.lower(text)
    return F.array_compact(F.array(*[F.when(low.rlike(X.java(p)), p) for p in C.OUTPUT_LEAK_PHRASES]))


def length_anomaly(prompt_chars: str = "prompt_chars", text: str = "output_text") -> Column:
    n, m = F.char_length(text), F.col(prompt_chars)
    return (F.when(m.isNull(), F.lit(None)).when((m > 0) & (n > m * 3), "response_length_anomaly")
            .when((m < 500) & (n > 5000), "high_output_without_high_input"))


def with_dlp(df: DataFrame, text: str = "output_text") -> DataFrame:
    df = dlp.score_columns(dlp.with_counts(df, text))
    return df.withColumn("dlp_score", capped("dlp_points"))


def output_action(df: DataFrame, text: str = "output_text") -> DataFrame:
    """Ordered decision.  Needs ``prompt_chars``, ``response_mode``, ``dlp_score`` and the guard columns."""
    c = F.col
    df = df.withColumn("leaks", leak_signals(text)).withColumn("anomaly", length_anomaly("prompt_chars", text))
    block = (c("guard_action") == "block") & (c("guard_confidence") >= 0.95) & (c("guard_risk") >= 85)
    soften = c("guard_action").isin("redact", "deny") | (c("guard_risk") >= 70)
    leaking = F.size("leaks") > 0
    code = (F.when(c("anomaly").isNotNull(), "OUTPUT_EXTRAPOLATION_DETECTED")
            .when(block, "LLM_OUTPUT_GUARD_BLOCK")
            .when(soften, "LLM_OUTPUT_GUARD_REDACT")
            .when(c("dlp_score") >= 50, "OUTPUT_DLP_HIGH_RISK")
            .when(leaking, "OUTPUT_PROMPT_OR_POLICY_LEAKAGE")
            .otherwise("OUTPUT_ALLOWED"))
    df = df.withColumn("output_code", code)
    said = F.when(F.startswith("output_code", F.lit("LLM_")), F.coalesce("guard_reasons", F.array().cast("array<string>"))) if "guard_reasons" in df.columns else F.lit(None)
    df = df.withColumn("output_reasons", F.concat(F.array("output_code"), F.coalesce(said.cast("array<string>"), F.array().cast("array<string>"))))
    df = df.withColumn("output_signals", F.concat("leaks", F.array_compact(F.array("anomaly"))))
    restricted_leak = (c("output_code") == "OUTPUT_PROMPT_OR_POLICY_LEAKAGE") & (c("response_mode") == "restricted")
    action = (F.when((c("output_code") == "LLM_OUTPUT_GUARD_BLOCK") | F.coalesce(restricted_leak, F.lit(False)), "block")
              .when(c("output_code") == "OUTPUT_ALLOWED", "allow").otherwise("redact"))
    df = df.withColumn("output_action", action)
    full = c(text)
    cut = F.when(F.char_length(full) > 500, F.concat(F.substring(full, 1, 500), F.lit("..."))).otherwise(full)
    final = (F.when(c("output_action") == "block", F.lit(None).cast("string"))
             .when(c("output_action") == "allow", full)
             .when(c("output_code") == "OUTPUT_EXTRAPOLATION_DETECTED", cut)
             .when(c("output_code") == "LLM_OUTPUT_GUARD_REDACT", R.redact_leaks(R.redact_output(full)))
             .when(c("output_code") == "OUTPUT_DLP_HIGH_RISK", R.redact_output(full))
             .otherwise(R.redact_leaks(full)))
    return df.withColumn("redacted_text", final)


def apply_output(df: DataFrame, text: str = "output_text") -> DataFrame:
    """Text the client sees: redacted, nothing when blocked, else the original."""
    return df.withColumn("client_text", F.when(F.col("output_action") == "redact", F.col("redacted_text"))
                         .when(F.col("output_action") == "block", F.lit(None).cast("string")).otherwise(F.col(text)))
