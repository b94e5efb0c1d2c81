"""Files of the reaction work: tables, chat records, overrides, model outputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from rxncurate.functions.checks import assert_unique


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A table with header and quoted, multi-line cells; a byte-order mark before the first name is dropped."""
    r = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    df = (r.schema(schema) if schema else r).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def write_csv(df: DataFrame, path: str, formats: dict[str, str] | None = None) -> None:
    """A table with header; formats maps columns to number formats such as %.6f."""
    formats = formats or {}
    df.select(*[F.format_string(formats[c], F.col(c).cast("double")).alias(c) if c in formats else F.col(c) for c in df.columns]).write.option("header", True).option("escape", '"').csv(path)


def read_chat_records(spark: SparkSession, path: str) -> DataFrame:
    """(record, messages, bad): lines of chat records; blank lines are skipped, others that are no object are bad."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = F.from_json("value", "messages array<struct<role string, content string>>")
    return lines.select(F.col("value").alias("record"), parsed["messages"].alias("messages"), (~F.startswith(F.trim("value"), F.lit("{")) | parsed["messages"].isNull()).alias("bad"))


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """(name, lookup_name, smiles, kind) of an override file: a list, or an object with `overrides`."""
    entry = "array<struct<name string, lookup_name string, smiles string, kind string>>"
    text = spark.read.option("wholetext", True).text(path).select(F.ltrim(F.regexp_replace("value", "﻿", "")).alias("v"))
    rows = F.when(F.startswith("v", F.lit("[")), F.from_json("v", entry)).otherwise(F.from_json("v", f"overrides {entry}")["overrides"])
    return text.select(F.inline(rows))


def read_model_outputs(spark: SparkSession, pattern: str, suffix: str = "_reaction_smiles_final") -> DataFrame:
    """Outputs of many models by one glob, with the model out of the file's name."""
    df = read_csv(spark, pattern)
    return df.withColumn("model", F.regexp_extract(F.col("_metadata.file_name"), rf"([^/]+){suffix}", 1))


def infer_reaction_column(columns: list[str], requested: str | None = None) -> str:
    """The requested column, or the only one that ends in _rxn and is no mapped form."""
    if requested:
        if requested not in columns:
            raise ValueError(f"no column {requested}")
        return requested
    found = [c for c in columns if c.endswith("_rxn") and not c.endswith(("_mapped_rxn", "_localmapper_rxn"))]
    if len(found) != 1:
        raise ValueError(f"one reaction column expected, found {found}")
    return found[0]


def to_long(df: DataFrame, ids: list[str], models: list[str], fields: list[str]) -> DataFrame:
    """Columns {model}_{field} of several models as rows (ids, model, fields)."""
    rows = F.array(*[F.struct(F.lit(m).alias("model"), *[F.col(f"{m}_{f}").alias(f) for f in fields]) for m in models])
    return df.select(*ids, F.inline(rows))


def attach_dictionaries(df: DataFrame, dictionaries: DataFrame, key: str = "idx") -> DataFrame:
    """df with the dictionary columns of equal key. Both sides have the same keys, each once; else the job
    fails, when it runs."""
    b = assert_unique(dictionaries, [key]).withColumn("_there", F.lit(True))
    joined = assert_unique(df, [key]).withColumn("_here", F.lit(True)).join(b, key, "full")
    both = F.col("_here").isNotNull() & F.col("_there").isNotNull()
    checked = F.when(both, F.lit(True)).otherwise(F.raise_error(F.lit("rows and dictionaries differ")).cast("boolean"))
    return joined.where(checked).drop("_here", "_there")


def write_dictionaries(df: DataFrame, path: str) -> None:
    """Rows as JSON lines, maps and arrays as they are; null fields are written."""
    df.write.option("ignoreNullFields", False).json(path)


def read_dictionaries(spark: SparkSession, path: str, schema: StructType | str = "idx long, smiles map<string,string>") -> DataFrame:
    """Rows that write_dictionaries wrote."""
    return spark.read.schema(schema).json(path)


def write_chat_records(df: DataFrame, path: str, messages: str = "messages") -> None:
    """Lines {"messages": [...]} of an array of struct(role, content)."""
    df.select(F.to_json(F.struct(F.col(messages).alias("messages"))).alias("value")).write.text(path)


def models_without_dictionary(outputs: DataFrame, dictionaries: DataFrame) -> DataFrame:
    """(model) of outputs that have no dictionary of equal model."""
    return outputs.select("model").distinct().join(dictionaries.select("model").distinct(), "model", "left_anti")
