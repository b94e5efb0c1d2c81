"""Identity of structures over whole tables: a dimension of distinct texts, and the keys of a row's components."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rxncurate.functions.structure import key_of, plain_text, read
from rxncurate.operators.once import FEW, FEW_CHARS
from rxncurate.operators.score import prediction_keys, signature_text

#: Schema of the dimension: text of a component, whether it is a structure, its key, and its key with charges.
DIMENSION = "text string, valid boolean, key string, strict_key string"


def structure_table(texts: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """The dimension rows of the distinct texts (column text) that known lacks; null texts have none. Each is
    read once, whatever the number of rows that hold it; a common text is gone before the work starts."""
    new = texts.select("text").where("text IS NOT NULL").distinct()
    if known is not None:
        new = new.join(known.select("text"), "text", "left_anti")
    # Reading a text takes far longer than a row's bytes tell: no coalescing of small partitions.
    parts = new.sparkSession.conf.get("spark.sql.shuffle.partitions")
    # Exploded from an array of one, as a filter on what is read (valid) then stays above it: it would else be moved
    # below the distinct, and every row's text be read.
    found = new.repartition(int(parts), "text").select("text", F.explode(F.array(read(F.col("text")))).alias("_s"))
    return found.select("text", "_s.valid", key_of(F.col("_s")).alias("key"), key_of(F.col("_s"), strict=True).alias("strict_key"))


def refresh_structures(spark: SparkSession, path: str, texts: DataFrame) -> DataFrame:
    """The stored dimension at path, after the texts that it lacks were read and appended. It is made where
    there is none. One writer at a time."""
    try:
        known = spark.read.schema(DIMENSION).parquet(path)
        known.isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        known = None
    structure_table(texts, known).write.mode("append").parquet(path)
    return spark.read.schema(DIMENSION).parquet(path)


def readable_keys(dimension: DataFrame) -> DataFrame:
    """dimension with, for a key, the least plain text of those of its texts: equal for equal structures among
    them, and what a person can read."""
    shown = dimension.where("valid").groupBy("key").agg(F.min(plain_text(F.col("text"))).alias("shown"))
    return dimension.join(shown, "key", "left").select("text", "valid", F.col("shown").alias("key"), "strict_key")


def key_literal(dimension: DataFrame, strict: bool = False) -> Column | None:
    """A literal map from the texts of a dimension to their keys; None where they are more than FEW."""
    rows = dimension.select("text", F.col("strict_key" if strict else "key").alias("key")).limit(FEW + 1).collect()
    if len(rows) > FEW:
        return None
    text = json.dumps({r["text"]: r["key"] for r in rows})
    return F.from_json(F.lit(text), "map<string,string>") if len(text) <= FEW_CHARS else None


def _texts(columns: Sequence[str]) -> Column:
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(*[F.coalesce(F.col(c), none) for c in columns]))


def with_key_map(df: DataFrame, ids: Sequence[str], columns: Sequence[str], dimension: DataFrame | None = None, strict: bool = False, whole: bool = False) -> DataFrame:
    """df, one row for each value of ids, with structure_keys: a map from the texts of the array columns to
    their keys, null for what is no structure. dimension: rows of structure_table that hold all the texts; without
    one they are read here. A dimension of few texts (key_literal) goes with the plan and nothing is
    shuffled (whole: the map may then hold other rows' texts too, which saves making one for each row); else texts meet it by a join, of which AQE splits common ones, and come back by ids."""
    each = df.select(*ids, F.explode(_texts(columns)).alias("text")).where("text IS NOT NULL")
    if dimension is None:
        dimension = structure_table(each)
    literal = key_literal(dimension, strict)
    if literal is not None:
        own = F.map_from_entries(F.transform(F.array_compact(_texts(columns)), lambda t: F.struct(t.alias("text"), F.try_element_at(literal, t).alias("key"))))
        return df.withColumn("structure_keys", literal if whole else own)
    key = F.col("strict_key" if strict else "key").alias("key")
    met = each.join(dimension.select("text", key), "text", "left").groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("text", "key"))).alias("structure_keys"))
    out = df.join(met, list(ids), "left")
    return out.withColumn("structure_keys", F.coalesce("structure_keys", F.create_map().cast("map<string,string>")))


def mapped_key(text: Column, keys: Column | str = "structure_keys") -> Column:
    """The key of a text in a map of with_key_map; null if it is no structure."""
    return F.try_element_at(F.col(keys) if isinstance(keys, str) else keys, text)


def is_mapped(text: Column, keys: Column | str = "structure_keys") -> Column:
    """Whether a text is a structure, by a map of with_key_map."""
    return mapped_key(text, keys).isNotNull()


def component_signatures(df: DataFrame, ids: Sequence[str], dimension: DataFrame | None = None) -> DataFrame:
    """df (ids and the arrays reactants, reagents, products) with signature, the JSON text of its structures'
    keys (reactants a multiset, the others sets): equal however molecules are written; null without products or
    with a part that is no structure. A prediction's parts, for scoring, are in the arrays <role>_keys, where
    an unreadable part stays as marked text."""
    roles = ("reactants", "reagents", "products")
    keyed = with_key_map(df, ids, roles, dimension, whole=True)
    keys = {r: F.transform(r, lambda c: mapped_key(c)) for r in roles}
    out = keyed.withColumn("signature", signature_text(*[keys[r] for r in roles]))
    return out.withColumns({f"{r}_keys": prediction_keys(keys[r], F.col(r)) for r in roles}).drop("structure_keys")
