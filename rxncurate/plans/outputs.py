"""Registered queries on what models made of a row: step flags, the denoising table, the stages of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rxncurate.operators import consensus, denoise, score
from rxncurate.plans.standins import standin, with_sql

_ARRAYS = ("skeletons", "reactions", "mapper_reactions", "mapped", "templates", "mapping_errors")


def _rows(spark, sf_dir):
    """Arrays of each row's steps in order, and its answer."""
    steps = standin(spark, sf_dir, "model_steps")
    item = F.struct("pos", *_ARRAYS)
    folded = steps.groupBy("idx").agg(F.array_sort(F.collect_list(item)).alias("s"))
    field = lambda c: F.transform("s", lambda x: x[c]).alias(c)
    rows = folded.select("idx", *[field(c) for c in _ARRAYS])
    smiles = F.create_map(F.lit("A"), F.lit("C"), F.lit("B"), F.when(F.col("idx") % 37 == 0, F.lit("not found")).otherwise(F.lit("CO")))
    return rows.join(standin(spark, sf_dir, "model_answers"), "idx").withColumn("smiles", smiles)


def _mapped(spark, sf_dir):
    """The texts of mapped steps, from the steps themselves."""
    return standin(spark, sf_dir, "model_steps").select(F.col("mapped").alias("text"))


def _labels(spark, sf_dir):
    """Ground truth of each row, as a manifest holds it."""
    labels = standin(spark, sf_dir, "model_answers").select("idx", "ground_truth_valid", "first_signature", "second_signature")
    accepted = F.filter(F.array("first_signature", "second_signature"), lambda s: s.isNotNull())
    return labels.select("idx", "ground_truth_valid", accepted.alias("alternatives"))


def _flags(spark, sf_dir):
    rows = denoise.row_heuristics(_rows(spark, sf_dir).drop("ground_truth_valid", "first_signature", "second_signature"), texts=_mapped(spark, sf_dir))
    return denoise.flag_table(rows, _labels(spark, sf_dir))


def row_heuristics(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = [f"max_{k}_count" for k in ("reactant", "reagent", "product")]
    return denoise.row_heuristics(_rows(spark, sf_dir), texts=_mapped(spark, sf_dir)).select("idx", "reaction_count", *counts, *denoise.STEP_FLAGS, "rare_template", "evaluation_error")


def flag_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = [f"{h}_{k}" for h in denoise.HEURISTICS for k in ("filtered", "passed")]
    return _flags(spark, sf_dir).select("idx", "matched_ground_truth", "noise_free", "noise_label", "model_output_issue", *kept)


def denoising_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir).select((F.col("idx") % 3).alias("model"), "noise_free", *denoise.HEURISTICS)
    return denoise.confusion_by_heuristic(flags, denoise.HEURISTICS)


def chart_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = _flags(spark, sf_dir).select(F.lit("m0").alias("model"), "noise_free", *denoise.HEURISTICS)
    chart = score.metrics_of(denoise.confusion_by_heuristic(flags, denoise.HEURISTICS), "m0")
    return chart.select("heuristic", "noise_free_saved_percent", "noisy_filtered_percent", "accuracy_percent")


def _staged(spark, sf_dir):
    f = _flags(spark, sf_dir)
    exact = denoise.extraction_exact(F.col("ground_truth_valid"), F.col("alternatives"), F.col("signature"), F.col("unresolved") == 1)
    predictions = standin(spark, sf_dir, "model_answers").select(F.col("prediction").alias("text"))
    return denoise.pipeline_flags(f.withColumn("extraction_exact", exact), predictions)


_STAGED = (*denoise.STAGES, "extraction_exact", "denoising_correct", "strict_end_to_end_success")


def pipeline_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _staged(spark, sf_dir).select("idx", "json_reaction_step_count", "reaction_step_count", "noise_free", *_STAGED)


def stage_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = denoise.stage_summary(_staged(spark, sf_dir), denoise.STAGES)
    return s.select("stage", "stage_order", "total", "reached", "passed", "failed", *[F.round(c, 6).alias(c) for c in ("conditional_rate", "overall_rate", "ci_lower", "ci_upper")])


def noise_free_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return denoise.noise_free_funnel(_staged(spark, sf_dir), denoise.STAGES, "extraction_exact").withColumn("conditional_rate", F.round("conditional_rate", 6))


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consensus.model_rows(_rows(spark, sf_dir).drop("unresolved", "signature"), ids=["idx"], texts=_mapped(spark, sf_dir), readable=True)
    parts = [F.array_join(c, ".").alias(c) for c in ("reactants", "reagents", "products")]
    return rows.select("idx", "complete", F.array_join("unresolved", ".").alias("unresolved"), *parts, "signature")


QUERIES = {f.__name__: f for f in (row_heuristics, flag_table, denoising_confusion, chart_metrics, pipeline_flags, stage_summary, noise_free_funnel, model_rows)}

# What each form of step of the stand-in is, by the rules for mapped steps: form 1 has reactants equal to its
# products; form 2 is sound; form 3 has three reactants, two products and an unmapped atom; form 0 is not mapped.
_STEP = """, st AS (SELECT *, CASE form WHEN 1 THEN 1 WHEN 2 THEN 2 WHEN 3 THEN 3 ELSE 0 END AS a, CASE form WHEN 1 THEN 1 WHEN 2 THEN 1 ELSE 0 END AS b, CASE form WHEN 3 THEN 2 ELSE 1 END AS n,
    CAST(form IN (0, 3) AS INT) AS missing, CAST(form = 1 AS INT) AS same,
    CASE WHEN form = 0 THEN CASE WHEN mapping_errors <> '' THEN mapping_errors ELSE 'mapped reaction is unavailable' END ELSE array_to_string([e FOR e IN [CASE WHEN form = 3 THEN 'product atom mapping is incomplete' END,
      CASE WHEN templates = '' THEN 'template extraction failed' END, CASE WHEN mapping_errors <> '' THEN mapping_errors END] IF e IS NOT NULL], ' | ') END AS err FROM model_steps),
  fl AS (SELECT idx, count(*) AS steps, max(a) AS ma, max(b) AS mb, max(n) AS mn, max(CAST(a > 2 AS INT)) AS many_reactants, max(CAST(n > 1 AS INT)) AS many_products, 0 AS many_reagents, max(CAST(form <> 0 AND b = 0 AS INT)) AS no_reagent,
    greatest(max(CAST(err <> '' AS INT)), max(model_answers.unresolved)) AS template_failure, max(missing) AS missing_product_atom_maps, max(same) AS identical_structures, max(model_answers.issue_rare) AS issue_rare, list(err ORDER BY pos) AS errs,
    count(*) FILTER (skeletons = '>B') AS bad_skeletons, count(*) FILTER (reactions = 'C>(NoSmi)') AS bad_reactions, count(*) FILTER (mapper_reactions = 'nan') AS bad_mapper, count(*) FILTER (form = 0) AS unmapped,
    count(*) FILTER (templates = '') AS bad_templates, count(*) FILTER (mapping_errors <> '') AS told
    FROM st JOIN model_answers USING (idx) GROUP BY idx),
  r AS (SELECT fl.*, greatest(issue_rare, template_failure, identical_structures) AS rare_template FROM fl),
  lb AS (SELECT r.*, x.* EXCLUDE (idx, issue_rare, unresolved), x.unresolved AS nosmi, ground_truth_valid AND x.signature IS NOT NULL AND x.unresolved = 0 AND template_failure = 0 AS fits FROM r JOIN model_answers x USING (idx)),
  ft AS (SELECT *, CASE WHEN NOT fits THEN 0 WHEN signature = first_signature THEN 1 WHEN signature = second_signature THEN 2 ELSE 0 END AS slot FROM lb),
  pf AS (SELECT *, CAST(prediction <> 'null' AND error IS NULL AS INT) AS s1, CAST(prediction LIKE '%->%' AS INT) AS s2 FROM ft),
  p2 AS (SELECT *, CAST(s1 = 1 AND s2 = 1 AND bad_skeletons = 0 AS INT) AS s3 FROM pf),
  p3 AS (SELECT *, CAST(s3 = 1 AND idx % 37 <> 0 AND bad_reactions = 0 AS INT) AS s4 FROM p2),
  p4 AS (SELECT *, CAST(s4 = 1 AND bad_mapper = 0 AND unmapped = 0 AND told = 0 AS INT) AS s5 FROM p3),
  p5 AS (SELECT *, CAST(s5 = 1 AND bad_templates = 0 AS INT) AS s6, CAST(ground_truth_valid AND coalesce(signature = first_signature OR signature = second_signature, FALSE) AND nosmi = 0 AS INT) AS exact FROM p4),
  x AS (SELECT idx, CAST(CASE WHEN prediction LIKE '%(Reaction%' THEN 1 ELSE 0 END AS INT) AS json_reaction_step_count, CAST(steps AS INT) AS reaction_step_count, CAST(ground_truth_valid AS INT) AS noise_free, s1 AS generation_success, s2 AS structured_output_success,
    s3 AS reaction_processing_success, s4 AS name_to_smiles_success, s5 AS atom_mapping_success, s6 AS template_processing_success, exact AS extraction_exact,
    CAST(CASE WHEN ground_truth_valid THEN rare_template = 0 ELSE rare_template = 1 END AS INT) AS denoising_correct,
    CAST(CASE WHEN ground_truth_valid THEN exact = 1 AND s5 = 1 AND s6 = 1 AND rare_template = 0 ELSE rare_template = 1 END AS INT) AS strict_end_to_end_success FROM p5)"""
_BASE = ["model_steps", "model_answers"]
_Z = "1.959963984540054"
_PASS = [" * ".join(denoise.STAGES[:k + 1]) for k in range(len(denoise.STAGES))]
_STAGE_ROWS = lambda t: " UNION ALL ".join(
    f"SELECT {k} AS stage_order, '{s}' AS stage, count(*) AS total, CAST(sum({'1' if not k else _PASS[k - 1]}) AS BIGINT) AS reached, CAST(sum({_PASS[k]}) AS BIGINT) AS passed FROM {t}" for k, s in enumerate(denoise.STAGES))
_END = lambda sign, bound: f"""CASE WHEN reached > 0 THEN {bound}((q + {_Z} * {_Z} / (2 * reached)) / (1 + {_Z} * {_Z} / reached) {sign} {_Z} * sqrt(q * (1 - q) / reached + {_Z} * {_Z} / (4.0 * reached * reached)) / (1 + {_Z} * {_Z} / reached), {0.0 if sign == '-' else 1.0}) END"""
_CONFUSED = """, long AS (UNPIVOT fl2 ON many_products, many_reactants, many_reagents, no_reagent, rare_template INTO NAME heuristic VALUE filtered),
  cells AS (SELECT model, heuristic, count(*) FILTER (noise_free = 1 AND filtered = 0) AS passed_tp, count(*) FILTER (noise_free = 1 AND filtered = 1) AS filtered_fn, count(*) FILTER (noise_free = 0 AND filtered = 0) AS passed_fp,
    count(*) FILTER (noise_free = 0 AND filtered = 1) AS filtered_tn FROM long GROUP BY model, heuristic),
  rates AS (SELECT *, CASE WHEN passed_tp + filtered_fn > 0 THEN passed_tp / (passed_tp + filtered_fn) ELSE 0.0 END AS noise_free_saved, CASE WHEN passed_fp + filtered_tn > 0 THEN filtered_tn / (passed_fp + filtered_tn) ELSE 0.0 END AS noisy_filtered,
    (passed_tp + filtered_tn) / (passed_tp + filtered_fn + passed_fp + filtered_tn) AS accuracy FROM cells)"""
_FLAGGED = lambda model: f", fl2 AS (SELECT {model} AS model, CAST(ground_truth_valid AS INT) AS noise_free, many_products, many_reactants, many_reagents, no_reagent, rare_template FROM ft)"
_HEUR = ("many_products", "many_reactants", "many_reagents", "no_reagent", "rare_template")

ORACLE = {
    "row_heuristics": with_sql(_BASE, _STEP + """ SELECT idx, CAST(steps AS INT) AS reaction_count, ma AS max_reactant_count, mb AS max_reagent_count, mn AS max_product_count, many_reactants, many_products, many_reagents, no_reagent, template_failure,
      missing_product_atom_maps, identical_structures, rare_template, array_to_string([e FOR e, i IN errs IF e <> '' AND list_position(errs, e) = i], ' | ') AS evaluation_error FROM r"""),
    "flag_table": with_sql(_BASE, _STEP + """ SELECT idx, slot AS matched_ground_truth, CAST(ground_truth_valid AS INT) AS noise_free, CASE WHEN ground_truth_valid THEN 'noise-free' ELSE 'noisy' END AS noise_label,
      CASE WHEN NOT ground_truth_valid THEN 'not_applicable_no_valid_ground_truth' WHEN nosmi = 1 THEN 'NoSmi_in_skeleton' WHEN template_failure = 1 THEN 'mapping_or_template_failure' WHEN signature IS NULL THEN 'invalid_model_components'
        WHEN slot = 0 THEN 'ground_truth_mismatch' ELSE '' END AS model_output_issue, """ + ", ".join(f"{h} AS {h}_filtered, 1 - {h} AS {h}_passed" for h in _HEUR) + " FROM ft"),
    "denoising_confusion": with_sql(_BASE, _STEP + _FLAGGED("idx % 3") + _CONFUSED + " SELECT * FROM rates"),
    "chart_metrics": with_sql(_BASE, _STEP + _FLAGGED("'m0'") + _CONFUSED + " SELECT heuristic, round(noise_free_saved * 100, 1) AS noise_free_saved_percent, round(noisy_filtered * 100, 1) AS noisy_filtered_percent, round(accuracy * 100, 1) AS accuracy_percent FROM rates"),
    "pipeline_flags": with_sql(_BASE, _STEP + " SELECT * FROM x"),
    "stage_summary": with_sql(_BASE, _STEP + f""", y AS (SELECT *, passed::DOUBLE / reached AS q FROM ({_STAGE_ROWS('x')})) SELECT stage, stage_order, total, reached, passed, reached - passed AS failed, round(passed / reached, 6) AS conditional_rate,
      round(passed / total, 6) AS overall_rate, round({_END('-', 'greatest')}, 6) AS ci_lower, round({_END('+', 'least')}, 6) AS ci_upper FROM y"""),
    "noise_free_funnel": with_sql(_BASE, _STEP + f""", free AS (SELECT * FROM x WHERE noise_free = 1), y AS ({_STAGE_ROWS('free')}) SELECT stage_order, stage, reached, passed, total, round(passed / reached, 6) AS conditional_rate, passed || '/' || total AS share FROM y
      UNION ALL SELECT 6, 'extraction_exact', NULL, CAST(sum(extraction_exact) AS BIGINT), count(*), NULL, CAST(sum(extraction_exact) AS BIGINT) || '/' || count(*) FROM free"""),
    "model_rows": with_sql(_BASE, _STEP + """, pa AS (SELECT idx, pos, unnest(CASE form WHEN 1 THEN [['r', '[CH3][OH]'], ['g', 'CC'], ['p', '[CH3][OH]']] WHEN 2 THEN [['r', '[CH3][Br]'], ['r', '[OH]'], ['g', 'O'], ['p', '[CH3][OH]']]
          WHEN 3 THEN [['r', '[CH3]'], ['r', '[OH]'], ['r', '[NH3]'], ['p', '[CH3][OH][NH2]'], ['p', '[CH3]C']] END) AS q FROM model_steps WHERE form > 0),
      kept AS (SELECT idx, pos, q[1] AS role, q[2] AS text, regexp_replace(q[2], '\\[([A-Za-z]+?)(H[0-9]*)?\\]', '\\1', 'g') AS key, row_number() OVER (PARTITION BY idx, q[1] ORDER BY pos, CASE q[2] WHEN '[CH3][OH][NH2]' THEN 0 WHEN '[CH3]C' THEN 1 WHEN '[CH3][Br]' THEN 0 WHEN '[CH3]' THEN 0 WHEN '[OH]' THEN 1 WHEN '[NH3]' THEN 2 ELSE 0 END) AS k FROM pa),
      firsts AS (SELECT *, row_number() OVER (PARTITION BY idx, role, key ORDER BY k) AS f FROM kept),
      ag AS (SELECT idx, string_agg(text, '.' ORDER BY k) FILTER (role = 'r') AS reactants, string_agg(text, '.' ORDER BY k) FILTER (role = 'g') AS reagents, string_agg(text, '.' ORDER BY k) FILTER (role = 'p' AND f = 1) AS products,
        string_agg(key, '.' ORDER BY key) FILTER (role = 'r') AS rk, string_agg(key, '.' ORDER BY key) FILTER (role = 'g' AND f = 1) AS gk, string_agg(key, '.' ORDER BY key) FILTER (role = 'p' AND f = 1) AS pk FROM firsts GROUP BY idx)
      SELECT r.idx, CAST(unmapped = 0 AND told = 0 AND ag.products IS NOT NULL AS INT) AS complete, '' AS unresolved, coalesce(reactants, '') AS reactants, coalesce(reagents, '') AS reagents, coalesce(products, '') AS products,
        CASE WHEN products IS NOT NULL THEN coalesce(rk, '') || '>' || coalesce(gk, '') || '>' || pk END AS signature FROM r LEFT JOIN ag USING (idx)"""),
}
