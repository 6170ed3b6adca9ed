"""Tool-call authorisation and execution records."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import dialect as X
from guardlake.functions import text as T
from guardlake.functions.rows import posexploded

CALLS = "array<struct<name:string,arguments:map<string,string>>>"


def tool_registry(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(C.TOOL_REGISTRY),
                                 "tool_name string, required_permission string, tool_sensitivity string, tool_enabled boolean")


def tool_calls(requests: DataFrame, requested: str = "requested_tools") -> DataFrame:
    """One row per requested call, with its position."""
    calls = F.from_json(F.col(requested), CALLS)
    kept = [c for c in requests.columns if c != requested]
    return (posexploded(requests.withColumn("_calls", calls), kept, "_calls", "call_pos", "_c")
            .withColumn("tool_name", F.coalesce(F.nullif(F.col("_c.name"), F.lit("")), F.lit("unknown")))
            .withColumn("arguments", F.coalesce(F.col("_c.arguments"), F.create_map().cast("map<string,string>")))
            .drop("_c"))


def any_argument(pattern: str, arguments: str = "arguments") -> Column:
    return F.exists(F.map_values(arguments), lambda v: F.coalesce(F.lower(v).rlike(pattern), F.lit(False)))


def arg_injection(arguments: str = "arguments") -> Column:
    return any_argument(X.any_of(C.TOOL_ARG_INJECTION), arguments)


def arg_chain(arguments: str = "arguments") -> Column:
    return any_argument(X.any_of(C.TOOL_ARG_CHAIN), arguments)


def sanitized_args(arguments: str = "arguments") -> Column:
    clean = lambda v: F.substring(T.strip(F.replace(v, F.lit("\x00"), F.lit(""))), 1, C.TOOL_ARG_CHARS)
    return F.transform_values(arguments, lambda _, v: clean(v))


def authorize(calls: DataFrame) -> DataFrame:
    """Ordered checks; the registry (four fixed rows) is broadcast, unknown tools stay in by a left join."""
    c = F.col
    known = calls.join(F.broadcast(tool_registry(calls.sparkSession)), "tool_name", "left")
    ceiling = F.coalesce(c("max_context_sensitivity"), F.lit(C.DEFAULT_CEILING))
    permitted = F.coalesce(F.array_contains("permissions", c("required_permission")), F.lit(False))
    reason = (F.when(c("required_permission").isNull(), "UNKNOWN_TOOL")
              .when(~c("tool_enabled"), "TOOL_DISABLED")
              .when(F.coalesce(c("disable_tools"), F.lit(False)), "TOOLS_DISABLED_BY_POLICY")
              .when(~permitted, "MISSING_TOOL_PERMISSION")
              .when(T.rank(c("tool_sensitivity"), C.SENSITIVITY_RANK) > T.rank(ceiling, C.SENSITIVITY_RANK),
                    "TOOL_SENSITIVITY_EXCEEDS_POLICY")
              .when(F.coalesce(c("label").isin(*C.HARD_ATTACK_LABELS), F.lit(False)), "TOOL_BLOCKED_BY_CONTENT_CLASSIFICATION")
              .when(arg_injection(), "TOOL_ARGUMENT_INJECTION_DETECTED")
              .when(arg_chain(), "TOOL_CHAIN_INJECTION_DETECTED")
              .otherwise("TOOL_ALLOWED"))
    decided = known.withColumn("decision", reason).withColumn("allowed", F.col("decision") == "TOOL_ALLOWED")
    return decided.withColumn("sanitized_arguments", F.when(c("allowed"), sanitized_args()))


def execution_records(decided: DataFrame, key: str = "trace_id") -> DataFrame:
    """One record per call.  The decision is looked up by tool name, so the last call of a
    name decides for all of them; the last one per (request, name) is pre-aggregated."""
    c = F.col
    last = decided.groupBy(key, "tool_name").agg(
        F.max_by(F.struct("allowed", "decision", "sanitized_arguments"), "call_pos").alias("d"))
    rendered = F.lower(F.to_json("d.sanitized_arguments"))
    chained = F.coalesce(rendered.rlike(X.any_of(C.TOOL_OUTPUT_CHAIN)), F.lit(False))
    return (decided.select(key, "tool_name", "call_pos").join(last, [key, "tool_name"])
            .withColumn("record_reason", F.when(~c("d.allowed"), c("d.decision"))
                        .when(chained, "TOOL_CHAIN_INJECTION_OUTPUT_DETECTED").otherwise("TOOL_EXECUTION_STUB"))
            .withColumn("executed", c("record_reason") == "TOOL_EXECUTION_STUB")
            .withColumn("record_arguments", F.when(c("executed"), c("d.sanitized_arguments")))
            .drop("d"))


def tool_usage(records: DataFrame, session: str = "session_id", key: str = "trace_id") -> DataFrame:
    """Requests with at least one executed call, per session."""
    used = records.groupBy(session, key).agg(F.bool_or("executed").alias("used"))
    return used.groupBy(session).agg(F.count_if("used").alias("tool_request_count"), F.count(F.lit(1)).alias("requests"))
