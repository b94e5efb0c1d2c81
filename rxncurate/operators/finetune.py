"""Chat records for fine-tuning."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Fixed value: the roles of a record, in order.
ROLES = ("system", "user", "assistant")


def assemble(turns: DataFrame) -> DataFrame:
    """(conv_id, messages): messages of (conv_id, turn, role, text) in order of turn."""
    m = F.array_sort(F.collect_list(F.struct("turn", "role", F.col("text").alias("content"))))
    return turns.groupBy("conv_id").agg(F.transform(m, lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))


def record_error(messages: Column) -> Column:
    """Why a record cannot be used; null for a good one."""
    roles = F.transform(messages, lambda m: m["role"])
    blank = F.exists(messages, lambda m: F.coalesce(F.trim(m["content"]), F.lit("")) == "")
    return F.when(F.size(messages) != len(ROLES), "not three messages").when(~F.coalesce(roles == F.array(*[F.lit(r) for r in ROLES]), F.lit(False)), "roles out of order").when(blank, "blank message")


def compact_target(text: str | None) -> str | None:
    """One compact JSON object, keys in their order, out of up to two encodings; None if it is none."""
    value: object = text.strip() if text is not None else None
    for _ in range(2):
        if not isinstance(value, str):
            break
        try:
            value = json.loads(value)
        except ValueError:
            break
    return json.dumps(value, ensure_ascii=False, separators=(",", ":")) if isinstance(value, dict) else None


@F.pandas_udf(StringType())
def target_json(content: pd.Series) -> pd.Series:
    """compact_target of each text. Spark's JSON functions sort keys or change numbers, and the order of
    steps is what a model is to learn; so this is one pass of json over Arrow batches."""
    return content.map(lambda t: None if pd.isna(t) else compact_target(t))


#: Fixed value: why a good record's target cannot be used.
NO_OBJECT = "Assistant target is not a JSON object after decoding."


def convert(records: DataFrame) -> DataFrame:
    """(conv_id, error, target): a record's error, and the target of a good one. A record whose target is
    no JSON object has that for its error."""
    checked = records.select("conv_id", record_error(F.col("messages")).alias("e"), F.try_element_at("messages", F.lit(-1))["content"].alias("c"))
    made = checked.withColumn("target", target_json(F.when(F.col("e").isNull(), F.col("c"))))
    error = F.coalesce("e", F.when(F.col("target").isNull(), F.lit(NO_OBJECT)))
    return made.select("conv_id", error.alias("error"), "target")


def summary(converted: DataFrame) -> DataFrame:
    """One row: records in, records that can be used, and valid targets among all."""
    return converted.agg(F.count(F.lit(1)).alias("records_in"), F.count_if(F.col("error").isNull()).alias("records_out"), F.count("target").alias("valid_targets"))


def role_counts(records: DataFrame) -> DataFrame:
    """Messages and records of each role."""
    return records.select("conv_id", F.explode("messages").alias("m")).groupBy(F.col("m.role").alias("role")).agg(F.count(F.lit(1)).alias("messages"), F.count_distinct("conv_id").alias("records"))
