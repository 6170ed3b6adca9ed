"""Request lists to message rows, and typed content parts to text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from guardlake import catalog as C
from guardlake.functions import text as T


def messages(requests: DataFrame, key: str = "trace_id", column: str = "messages") -> DataFrame:
    """One row per message of a request, with its index."""
    return (requests.select(key, F.posexplode(column).alias("msg_index", "m"))
            .select(key, "msg_index", "m.role", "m.content"))


def coerced_role(role: Column) -> Column:
    return F.when(role.isin(*C.ROLES), role).otherwise("user")


def coerced_content(raw: Column) -> Column:
    """Text of a JSON content: a string as it is, the text parts of a list, else its text form."""
    parsed = F.try_parse_json(raw)
    kind = F.schema_of_variant(parsed)
    parts = F.from_json(raw, "array<struct<type:string,text:string>>")
    texts = F.transform(F.filter(parts, lambda p: F.lower(p["type"]).isin("text", "input_text") & p["text"].isNotNull()),
                        lambda p: p["text"])
    return (F.when(kind == "STRING", F.try_variant_get(parsed, "$", "string"))
            .when(F.startswith(kind, F.lit("ARRAY")), T.strip(F.array_join(texts, "\n")))
            .when(kind == "VOID", F.lit("")).otherwise(raw))


def coerce_messages(rows: DataFrame, raw: str = "content_json") -> DataFrame:
    """Known roles, text content; blank messages are dropped."""
    return (rows.withColumn("role", coerced_role(F.col("role"))).withColumn("content", coerced_content(F.col(raw))).drop(raw)
            .filter(T.strip(F.col("content")) != ""))
