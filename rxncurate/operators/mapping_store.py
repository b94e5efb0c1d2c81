"""Atom mapping place by place: results stored by reaction, to which only unseen reactions are added."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxncurate.functions.reactions import EMPTY_REACTION, mapper_input

#: Schema of the store: what a mapper takes, and what it gave for it, or why it gave nothing.
STORE = "reaction string, mapped_rxn string, template string, confident boolean, error string"
#: Suffixes of the columns of mapping results; each is an array with one entry for each reaction.
COLUMNS = ("localmapper_rxn", "mapped_rxn", "mapping_template", "mapping_confident", "mapping_error")
FIELDS = ("reaction", "mapped_rxn", "template", "confident", "error")
#: What is wrong with a mapper's answer.
BAD_RESULT, BAD_NUMBER = "LocalMapper returned an invalid result.", "LocalMapper returned a different number of results."
#: Stored results that are sent with the tasks.
SENT = 100_000
#: A mapper: from reactions left>>products to a dict (mapped_rxn, template, confident) for each.
Mapper = Callable[[list[str]], list[dict]]


def _checked(answer: object) -> dict:
    if not isinstance(answer, dict) or not answer.get("mapped_rxn"):
        raise ValueError(BAD_RESULT)
    return {"mapped_rxn": answer["mapped_rxn"], "template": answer.get("template"), "confident": answer.get("confident"), "error": ""}


def _answers(mapper: Mapper, reactions: list[str]) -> list[dict]:
    """An answer for each reaction; where those of a batch are not all good, one reaction at a time."""
    try:
        got = list(mapper(reactions))
        if len(got) != len(reactions):
            raise ValueError(BAD_NUMBER)
        return [_checked(a) for a in got]
    except Exception as e:  # noqa: BLE001  whatever a user's mapper raises belongs to the reaction
        if len(reactions) == 1:
            return [{"mapped_rxn": None, "template": None, "confident": None, "error": f"{type(e).__name__}: {e}"}]
        return [a for r in reactions for a in _answers(mapper, [r])]


def map_distinct(reactions: DataFrame, mapper: Mapper, batch_size: int = 32) -> DataFrame:
    """STORE rows of the distinct values of column reaction, null ones left out."""
    if batch_size < 1:
        raise ValueError("batch_size must be at least 1")

    def run(frames):
        for frame in frames:
            texts = frame["reaction"].tolist()
            cut = (texts[k:k + batch_size] for k in range(0, len(texts), batch_size))
            answers = [a for part in cut for a in _answers(mapper, part)]
            yield pd.DataFrame(answers, columns=["mapped_rxn", "template", "confident", "error"]).assign(reaction=texts)[["reaction", "mapped_rxn", "template", "confident", "error"]]

    new = reactions.select("reaction").where("reaction IS NOT NULL").distinct()
    # A mapper's work has nothing to do with a row's bytes: no coalescing of small partitions.
    parts = int(new.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return new.repartition(parts, "reaction").mapInPandas(run, STORE)


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The stored results at path, one row for each reaction: of several the good one; None where there is no store."""
    try:
        rows = spark.read.schema(STORE).parquet(path)
        rows.isEmpty()
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    best = F.max_by(F.struct("mapped_rxn", "template", "confident", "error"), F.struct(F.col("mapped_rxn").isNotNull(), "mapped_rxn", "error"))
    return rows.groupBy("reaction").agg(best.alias("b")).select("reaction", "b.*")


def refresh_store(spark: SparkSession, path: str, reactions: DataFrame, mapper: Mapper, batch_size: int = 32, retry: bool = False) -> DataFrame:
    """The store at path after the mapper was given the reactions (column reaction) that it lacks, and with
    retry those too that only ever failed. Results are appended, so what was paid for is never lost; a job
    that is killed appends nothing. One writer at a time."""
    known = read_store(spark, path)
    new = reactions.select("reaction")
    if known is not None:
        new = new.join(known.where("mapped_rxn IS NOT NULL") if retry else known, "reaction", "left_anti")
    map_distinct(new, mapper, batch_size).write.mode("append").parquet(path)
    return read_store(spark, path)


def places(df: DataFrame, ids: Sequence[str], column: str) -> DataFrame:
    """(ids, place, reaction, error) of an array column of reactions: the form that a mapper takes, or why
    there is none. Empty and null entries are dropped; a row without others has one place that says so."""
    entries = F.filter(F.transform(F.coalesce(F.col(column), F.array().cast("array<string>")), lambda r: F.trim(r)), lambda r: r != "")
    some = F.when(F.size(entries) > 0, entries).otherwise(F.array(F.lit("")))
    each = df.select(*ids, F.posexplode(some).alias("place", "_r"))
    reaction, error = mapper_input(F.col("_r"))
    said = F.when(F.col("_r") == "", F.lit(EMPTY_REACTION)).otherwise(error)
    return each.select(*ids, "place", F.when(said.isNull(), reaction).alias("reaction"), said.alias("error"))


def with_mapping_columns(df: DataFrame, ids: Sequence[str], column: str, results: DataFrame, prefix: str = "") -> DataFrame:
    """df, one row for each value of ids, with the arrays of COLUMNS (behind prefix_): one entry for each of a
    row's reactions, in their order. The error is empty where mapping worked, and null where results
    (rows of STORE) lack the reaction, which then has yet to be mapped.

    One join by reaction, of which AQE splits a common one, and one aggregation by ids. Reactions without
    mapper input have a null key and do not take part in the join. Results of at most SENT rows are sent with the
    tasks; then only the aggregation shuffles."""
    each = places(df, ids, column)
    r = results.select("reaction", "mapped_rxn", "template", "confident", F.col("error").alias("_error"))
    few = results.limit(SENT + 1).count() <= SENT
    if few:
        both = each.join(F.broadcast(r), "reaction", "left").withColumn("error", F.coalesce("error", "_error")).drop("_error")
        return _with_entries(df, both, ids, prefix)
    met = each.where("reaction IS NOT NULL").join(r, "reaction", "left").withColumn("error", F.col("_error")).drop("_error")
    return _with_entries(df, met.unionByName(each.where("reaction IS NULL"), allowMissingColumns=True), ids, prefix)


def _with_entries(df: DataFrame, both: DataFrame, ids: Sequence[str], prefix: str) -> DataFrame:
    entry = F.struct("place", *[F.col(c) for c in FIELDS])
    rows = both.groupBy(*ids).agg(F.array_sort(F.collect_list(entry)).alias("_e"))
    name = lambda c: f"{prefix}_{c}" if prefix else c
    out = df.drop(*map(name, COLUMNS)).join(rows, list(ids), "left")
    return out.withColumns({name(c): F.col(f"_e.{f}") for c, f in zip(COLUMNS, FIELDS)}).drop("_e")


def mapper_inputs(df: DataFrame, ids: Sequence[str], column: str) -> DataFrame:
    """(reaction) of all places with a mapper input: what refresh_store is to be given."""
    return places(df, ids, column).select("reaction").where("reaction IS NOT NULL")
