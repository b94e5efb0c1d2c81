"""Registered queries: denoising, scoring and funnels."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxncurate.operators import denoise, score
from rxncurate.plans.standins import noise_flags, standin, with_sql
from rxncurate.sources.tables import table

HEURISTICS = ("many_products", "many_reactants", "many_reagents", "no_reagent", "template_anomaly")


def _templates(spark, sf_dir):
    return denoise.template_frequency(standin(spark, sf_dir, "template_rows"))


def template_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _templates(spark, sf_dir).select("source_row", "template", "template_frequency", "singleton")


def threshold_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.threshold_sensitivity(_templates(spark, sf_dir))


def confusion_by_heuristic(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.confusion_by_heuristic(noise_flags(_templates(spark, sf_dir)), HEURISTICS)


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("category"))
    return denoise.stratified_sample(o, "category", 100, [(F.col("o_orderkey") * 7919) % 10007, F.col("o_orderkey")])


def weighted_extrapolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    population = o.groupBy(F.col("o_orderpriority").alias("category")).agg(F.count(F.lit(1)).alias("population_n"))
    s = stratified_sample(spark, sf_dir).join(o.select("o_orderkey", "o_custkey", "o_orderstatus"), "o_orderkey")
    s = s.select("category", (F.col("o_custkey") % 4 != 0).cast("int").alias("noise_free"), (F.col("o_orderstatus") == "F").cast("int").alias("filtered"))
    cells = denoise.confusion(s, ["category"]).withColumnsRenamed({"passed_tp": "sample_tp", "filtered_fn": "sample_fn", "passed_fp": "sample_fp", "filtered_tn": "sample_tn"})
    cells = cells.withColumn("sample_n", F.col("sample_tp") + F.col("sample_fn") + F.col("sample_fp") + F.col("sample_tn")).join(population, "category")
    out = denoise.weighted_extrapolation(cells)
    return out.select("category", "population_n", "sample_n", *[F.round(c, 6).alias(c) for c in ("weight", "weighted_tp", "weighted_fn", "weighted_fp", "weighted_tn")])


METHODS = (0, 1, 2, 3)


def _compared(spark, sf_dir):
    pred = standin(spark, sf_dir, "pred_components", dealt=True).withColumn("unresolved", F.col("comp") == 0)
    return score.compare_alternatives(pred, standin(spark, sf_dir, "alternatives", dealt=True), METHODS, dealt=True)


def section_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = score.section_counts(_compared(spark, sf_dir))
    return counts.groupBy("method", "slot", "role").agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "exact", "covered")])


def best_ground_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.best_ground_truth(_compared(spark, sf_dir)).drop(*score.COUNTS)


def best_ground_truth_by_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.best_ground_truth(_compared(spark, sf_dir), prefer_coverage=True).drop(*score.COUNTS)


def _metrics(spark, sf_dir):
    return score.extraction_metrics(score.best_ground_truth(_compared(spark, sf_dir)))


def extraction_metrics_wilson(spark: SparkSession, sf_dir: str) -> DataFrame:
    real = ("precision", "recall", "accuracy", "ci_lower", "ci_upper")
    m = _metrics(spark, sf_dir).drop("excluded")
    return m.select(*[F.round(c, 6).alias(c) if c in real else F.col(c) for c in m.columns])


def excluded_reactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every tenth reaction has no valid ground truth: it is left out of the metrics, and counted."""
    key = F.col("o_orderkey")
    review = table(spark, sf_dir, "orders").select(key.alias("idx"), F.when(key % 10 == 0, "False").otherwise("yes").alias("ground_truth_valid"), F.lit("S").alias("signature_1"), F.lit(None).cast("string").alias("signature_2"), F.col("o_orderpriority").alias("review_note"))
    manifest = score.ground_truth_manifest(review)
    valid = manifest.where("ground_truth_valid").select(F.col("idx").alias("rxn_id"))
    flags = score.best_ground_truth(_compared(spark, sf_dir)).join(valid, "rxn_id", "left_semi")
    m = score.extraction_metrics(score.with_excluded(flags, manifest, METHODS)).where("role = 'products'")
    return m.select("method", "evaluated", "correct", "excluded", "tp", "fp", "fn")


def best_configuration_per_family(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _metrics(spark, sf_dir).where("role = 'products'").select("method", "correct", "evaluated", "accuracy")
    return score.best_configuration(m, (F.col("method") / 2).cast("int"), F.col("method") % 2).select("family", "method", "effort", "correct", "evaluated", F.round("accuracy", 6).alias("accuracy"))


def publication_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.publication_table(_metrics(spark, sf_dir))


QUERIES = {f.__name__: f for f in (
    template_frequency, threshold_sensitivity, confusion_by_heuristic, stratified_sample, weighted_extrapolation, section_counts, best_ground_truth, best_ground_truth_by_coverage,
    extraction_metrics_wilson, excluded_reactions, best_configuration_per_family, publication_table)}

_FREQ = """, f AS (SELECT t.*, c.n AS template_frequency, CASE WHEN c.n = 1 THEN 1 ELSE 0 END AS singleton
  FROM template_rows t JOIN (SELECT template, count(*) AS n FROM template_rows GROUP BY template) c USING (template))"""
_CELLS = """CAST(sum(CASE WHEN noise_free = 1 AND filtered = 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed_tp, CAST(sum(CASE WHEN noise_free = 1 AND filtered = 1 THEN 1 ELSE 0 END) AS BIGINT) AS filtered_fn,
  CAST(sum(CASE WHEN noise_free = 0 AND filtered = 0 THEN 1 ELSE 0 END) AS BIGINT) AS passed_fp, CAST(sum(CASE WHEN noise_free = 0 AND filtered = 1 THEN 1 ELSE 0 END) AS BIGINT) AS filtered_tn"""
_RATES = """*, CASE WHEN passed_tp + filtered_fn > 0 THEN passed_tp / (passed_tp + filtered_fn) ELSE 0.0 END AS noise_free_saved,
  CASE WHEN passed_fp + filtered_tn > 0 THEN filtered_tn / (passed_fp + filtered_tn) ELSE 0.0 END AS noisy_filtered,
  CASE WHEN passed_tp + filtered_fn + passed_fp + filtered_tn > 0 THEN (passed_tp + filtered_tn) / (passed_tp + filtered_fn + passed_fp + filtered_tn) ELSE 0.0 END AS accuracy"""
_SAMPLE = """ s AS (SELECT o_orderkey, category FROM (SELECT o_orderkey, o_orderpriority AS category,
  row_number() OVER (PARTITION BY o_orderpriority ORDER BY (o_orderkey * 7919) % 10007, o_orderkey) AS r FROM orders) WHERE r <= 100)"""
_SECTIONS = """, methods AS (SELECT unnest([0, 1, 2, 3]) AS method), roles AS (SELECT unnest(['reactants', 'reagents', 'products']) AS role),
pairs AS (SELECT rxn_id, slot, method FROM (SELECT DISTINCT rxn_id, slot FROM alternatives) CROSS JOIN methods),
p AS (SELECT rxn_id, method, role, comp, CASE WHEN role = 'reactants' THEN count(*) ELSE 1 END AS n FROM pred_components GROUP BY rxn_id, method, role, comp),
g AS (SELECT rxn_id, slot, role, comp, CASE WHEN role = 'reactants' THEN count(*) ELSE 1 END AS n FROM alternatives GROUP BY rxn_id, slot, role, comp),
pp AS (SELECT pairs.*, role, comp, n FROM pairs JOIN p USING (rxn_id, method)),
gg AS (SELECT pairs.*, role, comp, n FROM pairs JOIN g USING (rxn_id, slot)),
c AS (SELECT coalesce(pp.rxn_id, gg.rxn_id) AS rxn_id, coalesce(pp.method, gg.method) AS method, coalesce(pp.slot, gg.slot) AS slot, coalesce(pp.role, gg.role) AS role,
             coalesce(pp.n, 0) AS a, coalesce(gg.n, 0) AS b
      FROM pp FULL JOIN gg ON pp.rxn_id = gg.rxn_id AND pp.method = gg.method AND pp.slot = gg.slot AND pp.role = gg.role AND pp.comp = gg.comp),
q AS (SELECT rxn_id, method, slot, role, sum(least(a, b)) AS tp, sum(greatest(a - b, 0)) AS fp, sum(greatest(b - a, 0)) AS fn FROM c GROUP BY ALL),
sections AS (SELECT rxn_id, method, slot, role, CAST(coalesce(tp, 0) AS BIGINT) AS tp, CAST(coalesce(fp, 0) AS BIGINT) AS fp, CAST(coalesce(fn, 0) AS BIGINT) AS fn,
  CASE WHEN coalesce(fp, 0) = 0 AND coalesce(fn, 0) = 0 THEN 1 ELSE 0 END AS exact, CASE WHEN coalesce(fn, 0) = 0 THEN 1 ELSE 0 END AS covered
  FROM (SELECT * FROM pairs CROSS JOIN roles) LEFT JOIN q USING (rxn_id, method, slot, role))"""
_BEST = """, cmp AS (SELECT rxn_id, method, slot, min(exact) AS exact, min(covered) AS covered, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp + fn) AS BIGINT) AS errors FROM sections GROUP BY ALL),
flags AS (SELECT b.*, CASE WHEN u.rxn_id IS NULL THEN 0 ELSE 1 END AS has_unresolved, CASE WHEN exact = 1 AND u.rxn_id IS NULL THEN 1 ELSE 0 END AS reaction_correct
  FROM (SELECT * FROM cmp QUALIFY row_number() OVER (PARTITION BY rxn_id, method ORDER BY exact DESC, tp DESC, errors, slot) = 1) b
  LEFT JOIN (SELECT DISTINCT rxn_id, method FROM pred_components WHERE comp = 0) u USING (rxn_id, method))"""
_Z = "1.959963984540054"
_WILSON = lambda k, n: (
    f"greatest(0.0, ({k} / {n} + {_Z} * {_Z} / (2 * {n})) / (1 + {_Z} * {_Z} / {n}) - {_Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {_Z} * {_Z} / (4.0 * {n} * {n})) / (1 + {_Z} * {_Z} / {n}))",
    f"least(1.0, ({k} / {n} + {_Z} * {_Z} / (2 * {n})) / (1 + {_Z} * {_Z} / {n}) + {_Z} * sqrt({k} / {n} * (1 - {k} / {n}) / {n} + {_Z} * {_Z} / (4.0 * {n} * {n})) / (1 + {_Z} * {_Z} / {n}))")
_LOW, _HIGH = _WILSON("correct::DOUBLE", "evaluated::DOUBLE")
_METRICS = f""", m AS (
  SELECT s.method, s.role, s.tp, s.fp, s.fn, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) END AS precision, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) END AS recall,
         evaluated, correct, evaluated - correct AS incorrect, correct / evaluated AS accuracy, {_LOW} AS ci_lower, {_HIGH} AS ci_upper
  FROM (SELECT method, role, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn FROM sections JOIN flags USING (rxn_id, method, slot) GROUP BY ALL) AS s (method, role, tp, fp, fn)
  JOIN (SELECT method, count(*) AS evaluated, CAST(sum(reaction_correct) AS BIGINT) AS correct FROM flags GROUP BY method) r ON r.method = s.method)"""
_METRICS = _METRICS.replace("sections JOIN flags USING (rxn_id, method, slot)", "(SELECT sections.* FROM sections JOIN flags USING (rxn_id, method, slot))")
_SCORING = ["pred_components", "alternatives"]

ORACLE = {
    "template_frequency": with_sql(["template_rows"], _FREQ + " SELECT source_row, template, template_frequency, singleton FROM f"),
    "threshold_sensitivity": with_sql(["template_rows"], _FREQ + f""", t AS (SELECT * FROM (VALUES ('N=1', 1, NULL), ('N<5', NULL, 5), ('N<10', NULL, 10)) v(threshold, exact, below)),
      x AS (SELECT threshold, noise_free, CASE WHEN coalesce(template_frequency = exact, FALSE) OR coalesce(template_frequency > 0 AND template_frequency < below, FALSE) OR template_failure = 1 OR identical_structures = 1 THEN 1 ELSE 0 END AS filtered FROM f CROSS JOIN t),
      y AS (SELECT threshold, {_CELLS} FROM x GROUP BY threshold) SELECT {_RATES} FROM y"""),
    "confusion_by_heuristic": with_sql(["template_rows"], _FREQ + f""", h AS (SELECT model, noise_free, many_products, many_reactants, many_reagents, no_reagent, greatest(singleton, template_failure, identical_structures) AS template_anomaly FROM f),
      x AS (UNPIVOT h ON many_products, many_reactants, many_reagents, no_reagent, template_anomaly INTO NAME heuristic VALUE filtered),
      y AS (SELECT model, heuristic, {_CELLS} FROM x GROUP BY model, heuristic) SELECT {_RATES} FROM y"""),
    "stratified_sample": f"WITH {_SAMPLE} SELECT * FROM s",
    "weighted_extrapolation": f"""WITH {_SAMPLE}, x AS (SELECT category, CASE WHEN o_custkey % 4 <> 0 THEN 1 ELSE 0 END AS noise_free, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS filtered FROM s JOIN orders USING (o_orderkey)),
      y AS (SELECT category, {_CELLS}, count(*) AS sample_n FROM x GROUP BY category), p AS (SELECT o_orderpriority AS category, count(*) AS population_n FROM orders GROUP BY 1),
      w AS (SELECT category, population_n, sample_n, population_n / sample_n AS weight, passed_tp * population_n / sample_n AS weighted_tp, filtered_fn * population_n / sample_n AS weighted_fn, passed_fp * population_n / sample_n AS weighted_fp, filtered_tn * population_n / sample_n AS weighted_tn FROM y JOIN p USING (category))
      SELECT category, population_n, sample_n, round(weight, 6) AS weight, round(weighted_tp, 6) AS weighted_tp, round(weighted_fn, 6) AS weighted_fn, round(weighted_fp, 6) AS weighted_fp, round(weighted_tn, 6) AS weighted_tn FROM w
      UNION ALL SELECT 'TOTAL', CAST(sum(population_n) AS BIGINT), CAST(sum(sample_n) AS BIGINT), NULL, round(sum(weighted_tp), 6), round(sum(weighted_fn), 6), round(sum(weighted_fp), 6), round(sum(weighted_tn), 6) FROM w""",
    "section_counts": with_sql(_SCORING, _SECTIONS + " SELECT method, slot, role, CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(exact) AS BIGINT) AS exact, CAST(sum(covered) AS BIGINT) AS covered FROM sections GROUP BY method, slot, role"),
    "best_ground_truth": with_sql(_SCORING, _SECTIONS + _BEST + " SELECT rxn_id, method, slot, exact, covered, tp, errors, has_unresolved, reaction_correct FROM flags"),
    "best_ground_truth_by_coverage": with_sql(_SCORING, _SECTIONS + _BEST.replace("ORDER BY exact DESC", "ORDER BY covered DESC, exact DESC").replace("WHEN exact = 1 AND u.rxn_id IS NULL THEN 1", "WHEN covered = 1 THEN 1") + " SELECT rxn_id, method, slot, exact, covered, tp, errors, has_unresolved, reaction_correct FROM flags"),
    "extraction_metrics_wilson": with_sql(_SCORING, _SECTIONS + _BEST + _METRICS + " SELECT * REPLACE (round(precision, 6) AS precision, round(recall, 6) AS recall, round(accuracy, 6) AS accuracy, round(ci_lower, 6) AS ci_lower, round(ci_upper, 6) AS ci_upper) FROM m"),
    "excluded_reactions": with_sql(_SCORING, _SECTIONS + _BEST + """ SELECT f.method, count(*) AS evaluated, CAST(sum(reaction_correct) AS BIGINT) AS correct, (SELECT count(*) FROM orders WHERE o_orderkey % 10 = 0) AS excluded, CAST(sum(s.tp) AS BIGINT) AS tp,
      CAST(sum(s.fp) AS BIGINT) AS fp, CAST(sum(s.fn) AS BIGINT) AS fn FROM flags f JOIN sections s ON s.rxn_id = f.rxn_id AND s.method = f.method AND s.slot = f.slot AND s.role = 'products' WHERE f.rxn_id % 10 <> 0 GROUP BY f.method"""),
    "best_configuration_per_family": with_sql(_SCORING, _SECTIONS + _BEST + _METRICS + """ SELECT CAST(method // 2 AS INT) AS family, method, method % 2 AS effort, correct, evaluated, round(accuracy, 6) AS accuracy FROM m WHERE role = 'products'
      QUALIFY row_number() OVER (PARTITION BY method // 2 ORDER BY accuracy DESC, method % 2, method) = 1"""),
    "publication_table": with_sql(_SCORING, _SECTIONS + _BEST + _METRICS + " SELECT method, " + ", ".join(f"max(CASE WHEN role = '{r}' THEN printf('%.4f', {k} * 100) END) AS {r}_{k}_pct" for r in ("reactants", "reagents", "products") for k in ("precision", "recall"))
      + ", printf('%.4f', any_value(accuracy) * 100) || ' (' || printf('%.4f', any_value(ci_lower) * 100) || '–' || printf('%.4f', any_value(ci_upper) * 100) || ')' AS accuracy_ci FROM m GROUP BY method"),
}
