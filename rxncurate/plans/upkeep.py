"""Registered queries of what keeps a long job right: leaks of evaluation items, stored mappings, resumed
runs and checks that ride on a job; with their DuckDB statements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxncurate.functions import checks
from rxncurate.operators import checkpoint, containment, mapping_store
from rxncurate.plans.standins import noise_flags, standin, with_sql
from rxncurate.sources.shared import shared_dir, stored
from rxncurate.sources.tables import table


def eval_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), ["doc_id"])


def eval_containment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return containment.containment(eval_containment(spark, sf_dir), table(spark, sf_dir, "benchmark"))


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of several reactions each, some without any, some that no mapper takes."""
    order = F.array_sort(F.collect_list(F.struct("pos", "value")))
    steps = standin(spark, sf_dir, "place_steps")
    return steps.groupBy("idx").agg(F.transform(order, lambda s: s["value"]).alias("reactions"))


def _mapper(reactions: list[str]) -> list[dict]:
    """Stands for a model: numbers the first carbon; fails for batches with bromine, and reactions of it."""
    if any("Br" in r for r in reactions):
        raise RuntimeError("no bromine")
    return [{"mapped_rxn": r.replace("C", "[CH3:1]", 1), "template": "T" + str(len(r)), "confident": len(r) % 2 == 0} for r in reactions]


def mapping_places(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, path = stored(_places(spark, sf_dir)), shared_dir(spark)
    asked = stored(mapping_store.mapper_inputs(rows, ["idx"], "reactions").distinct())  # read twice below
    mapping_store.refresh_store(spark, path, asked.where(F.length("reaction") % 2 == 0), _mapper)
    results = mapping_store.refresh_store(spark, path, asked, _mapper)
    out = mapping_store.with_mapping_columns(rows, ["idx"], "reactions", results, "m")
    shown = lambda c: F.array_join(F.transform(F.col(f"m_{c}").cast("array<string>"), lambda v: F.coalesce(v, F.lit("-"))), "|").alias(c)
    return out.select("idx", *[shown(c) for c in mapping_store.COLUMNS])


def checkpoint_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint after three updates; one that comes under a name that was committed is not applied."""
    o, path = table(spark, sf_dir, "orders"), shared_dir(spark)
    rows = lambda rule, text, v: o.where(rule).select(F.col("o_orderkey").alias("idx"), F.lit(text).alias("prediction"), F.lit(v).alias("version"))
    updates = [("first", rows("o_orderkey % 10 <> 3", "old", 0)), ("second", rows("o_orderkey % 10 IN (3, 4)", "new", 1)), ("second", rows("o_orderkey % 2 = 0", "again", 2)), ("third", rows("o_orderkey % 100 = 7", "last", 3))]
    for name, new in updates:
        checkpoint.apply_update(spark, path, new, name, version="version", buckets=16)
    return checkpoint.read_checkpoint(spark, path, "idx long, prediction string, version int")


def watched_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of a heuristic, whose flags and cells were checked while they were written."""
    rows = standin(spark, sf_dir, "template_rows").withColumn("singleton", (F.col("template_failure") + F.col("many_products") > 1).cast("int"))
    flags = noise_flags(rows).withColumn("passed", 1 - F.col("template_anomaly"))
    seen = checks.Watched(flags, {"flags": checks.complementary(F.col("passed"), F.col("template_anomaly")), "model": F.col("model").isNotNull()})
    kept = stored(seen.rows)
    n = seen.verify()
    cell = lambda a, b: F.count_if((F.col("noise_free") == a) & (F.col("passed") == b))
    cells = kept.groupBy("model").agg(cell(1, 1).alias("kept_clean"), cell(1, 0).alias("lost_clean"), cell(0, 1).alias("kept_noise"), cell(0, 0).alias("lost_noise"), F.count(F.lit(1)).alias("total"))
    parts = [F.col(c) for c in ("kept_clean", "lost_clean", "kept_noise", "lost_noise")]
    summed = checks.Watched(cells, {"cells": checks.sums_to(parts, F.col("total"))})
    out = stored(summed.rows)
    summed.verify()
    return out.withColumn("all_rows", F.lit(n))


QUERIES = {f.__name__: f for f in (eval_containment, eval_containment_counts, mapping_places, checkpoint_buckets, watched_flags)}

_FOUND = r"""WITH d AS (SELECT doc_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS t FROM documents),
  b AS (SELECT item_id, ' ' || trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) || ' ' AS i FROM benchmark),
  f AS (SELECT item_id, doc_id, CAST(greatest(len(string_split(t[1:strpos(t, i)], ' ')) - 2, 0) AS INT) AS word_at FROM d JOIN b ON contains(t, i) WHERE i <> '  ')"""

ORACLE = {
    "eval_containment": _FOUND + " SELECT * FROM f",
    "eval_containment_counts": _FOUND + " SELECT item_id, count(doc_id) AS rows_with_item FROM benchmark LEFT JOIN f USING (item_id) GROUP BY item_id",
    "mapping_places": with_sql(["place_steps"], r""", p AS (SELECT idx, pos, trim(value) AS v FROM place_steps WHERE trim(value) <> ''),
      s AS (SELECT *, string_split(v, '>') AS s FROM p),
      l AS (SELECT *, array_to_string(list_filter(s[1:len(s) - 1], lambda x: x <> ''), '.') AS left_side, s[-1] AS right_side FROM s),
      e AS (SELECT idx, pos, CASE WHEN contains(v, '(NoSmi)') THEN 'Reaction contains an unresolved (NoSmi) compound.' WHEN contains(v, 'Error:') THEN v
        WHEN len(s) < 2 THEN 'Reaction must contain at least one ''>'' separator between reactants and products.'
        WHEN left_side = '' OR right_side = '' THEN 'Reaction must contain both reactants and products.' END AS e, left_side || '>>' || right_side AS r FROM l),
      m AS (SELECT idx, pos, CASE WHEN e IS NULL THEN r END AS r, CASE WHEN e IS NULL AND NOT contains(r, 'Br') THEN r END AS good, coalesce(e, CASE WHEN contains(r, 'Br') THEN 'RuntimeError: no bromine' ELSE '' END) AS err FROM e
        UNION ALL SELECT idx, 0, NULL, NULL, 'Reaction SMILES is empty.' FROM (SELECT DISTINCT idx FROM place_steps) k WHERE idx NOT IN (SELECT idx FROM e))
      SELECT idx, string_agg(coalesce(r, '-'), '|' ORDER BY pos) AS localmapper_rxn, string_agg(coalesce(regexp_replace(good, 'C', '[CH3:1]'), '-'), '|' ORDER BY pos) AS mapped_rxn,
        string_agg(coalesce('T' || length(good), '-'), '|' ORDER BY pos) AS mapping_template, string_agg(coalesce(CAST(length(good) % 2 = 0 AS VARCHAR), '-'), '|' ORDER BY pos) AS mapping_confident,
        string_agg(err, '|' ORDER BY pos) AS mapping_error FROM m GROUP BY idx"""),
    "checkpoint_buckets": """SELECT o_orderkey AS idx, CASE WHEN o_orderkey % 100 = 7 THEN 'last' WHEN o_orderkey % 10 IN (3, 4) THEN 'new' ELSE 'old' END AS prediction,
      CAST(CASE WHEN o_orderkey % 100 = 7 THEN 3 WHEN o_orderkey % 10 IN (3, 4) THEN 1 ELSE 0 END AS INT) AS version FROM orders""",
    "watched_flags": with_sql(["template_rows"], """, f AS (SELECT model, noise_free, 1 - greatest(CASE WHEN template_failure + many_products > 1 THEN 1 ELSE 0 END, template_failure, identical_structures) AS passed FROM template_rows)
      SELECT model, count(*) FILTER (noise_free = 1 AND passed = 1) AS kept_clean, count(*) FILTER (noise_free = 1 AND passed = 0) AS lost_clean, count(*) FILTER (noise_free = 0 AND passed = 1) AS kept_noise,
        count(*) FILTER (noise_free = 0 AND passed = 0) AS lost_noise, count(*) AS total, (SELECT count(*) FROM f) AS all_rows FROM f GROUP BY model"""),
}
