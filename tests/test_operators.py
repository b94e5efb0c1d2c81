"""Operators against literals and published results."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rxncurate.operators import denoise, finetune, names, review, skeleton


def test_weighted_extrapolation_total(spark):
    rows = [("a", 100, 10, 6, 1, 2, 1), ("b", 50, 10, 1, 2, 3, 4)]
    df = spark.createDataFrame(rows, "category string, population_n long, sample_n long, sample_tp long, sample_fn long, sample_fp long, sample_tn long")
    got = {r["category"]: r for r in denoise.weighted_extrapolation(df).collect()}
    assert got["TOTAL"]["weighted_tp"] == 65.0 and got["TOTAL"]["weight"] is None and got["b"]["weighted_tn"] == 20.0


def test_confusion_cells(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (0, 0), (0, 1)], "noise_free int, filtered int").withColumn("model", F.lit("m"))
    r = denoise.with_rates(denoise.confusion(df, ["model"])).first()
    assert (r["passed_tp"], r["filtered_fn"], r["passed_fp"], r["filtered_tn"], r["accuracy"]) == (1, 1, 1, 1, 0.5)


def test_thresholds(spark):
    rows = [(1, 1, 0, 0), (1, 4, 0, 0), (0, 9, 0, 0), (0, 0, 0, 0), (0, 50, 1, 0), (1, 50, 0, 1)]
    df = spark.createDataFrame(rows, "noise_free int, template_frequency long, template_failure int, identical_structures int")
    got = {r["threshold"]: (r["passed_tp"], r["filtered_fn"], r["passed_fp"], r["filtered_tn"]) for r in denoise.threshold_sensitivity(df).collect()}
    assert got == {"N=1": (1, 2, 2, 1), "N<5": (0, 3, 2, 1), "N<10": (0, 3, 1, 2)}


def steps(spark, rows, products=("B",)):
    return spark.createDataFrame([(1, list(products), rows)], "idx int, products array<string>, steps array<struct<step_key string, equation string>>")


def test_skeleton_of_self_reference(spark):
    df = steps(spark, [("1 (Reaction, mix)", "A->mixture1"), ("2 (Reaction, stir)", "mixture1->mixture1"), ("3 (Work-up, filter)", "mixture1->B")])
    df = skeleton.with_skeletons(df).withColumn("smiles", F.create_map(F.lit("A"), F.lit("CC"), F.lit("B"), F.lit("CO")))
    r = skeleton.with_reactions(df).first()
    assert r["skeletons"] == ["A>B"] and r["reactions"] == ["CC>CO"]


def test_skeletons_of_shared_inputs_and_repeated_products(spark):
    rows = [("1 (Reaction)", "A+C->mixture1"), ("2 (Reaction)", "C+A->mixture2"), ("3 (Work-up-involve)", "D+mixture1->B"), ("4 (Reaction)", "E->B2"), ("5 (Reaction)", "F->mixture3"), ("6 (Reaction)", "G+mixture3->B2"), ("7 (Reaction)", "H->mixture4")]
    df = skeleton.with_skeletons(steps(spark, rows))
    assert df.first()["skeletons"] == ["A.C>D>B", "G>B2"]
    # An equation's arrow is looked for once, not for each side and check.
    assert df._jdf.queryExecution().analyzed().toString().count("equation, ->") == 1


def test_malformed_skeletons(spark):
    assert skeleton.with_skeletons(steps(spark, [("1 (Reaction)", "A B")])).first()["skeletons"] is None
    assert skeleton.with_skeletons(steps(spark, [("x (Reaction)", "A->B")])).first()["skeletons"] is None
    assert skeleton.with_reactions(skeleton.with_skeletons(steps(spark, [("1 (Work-up)", "A->B")])).withColumn("smiles", F.create_map(F.lit("A"), F.lit("C")))).first()["reactions"] == ["Error: empty rxn_codes"]


def test_lineage(spark):
    e = spark.createDataFrame([(1, "m2", "m1"), (1, "m1", "A"), (1, "m1", "B"), (1, "P", "m2"), (1, "P", "C")], "idx int, node string, input string")
    got = {(r["node"], r["base"]) for r in skeleton.expand_inputs(e).collect()}
    assert {b for n, b in got if n == "P"} == {"A", "B", "C"} and {b for n, b in got if n == "m2"} == {"A", "B"}


def test_lineage_of_long_chains_and_cycles(spark):
    chain = [(1, f"n{k}", f"n{k + 1}") for k in range(50)] + [(1, "n50", "A"), (1, "n3", "B")]
    cycle = [(2, "x", "y"), (2, "y", "x"), (2, "y", "C"), (2, "s", "s"), (2, "P", "x"), (2, "P", "s")]
    e = spark.createDataFrame(chain + cycle, "idx int, node string, input string")
    got = {(r["idx"], r["node"], r["base"]) for r in skeleton.expand_inputs(e).collect()}
    assert got == {(1, f"n{k}", "A") for k in range(51)} | {(1, f"n{k}", "B") for k in range(4)} | {(2, n, "C") for n in "xyP"}
    assert {(r["idx"], r["node"]) for r in skeleton.cyclic_nodes(e).collect()} == {(2, "x"), (2, "y"), (2, "s")}


def test_names_resolve_once(spark):
    occ = spark.createDataFrame([(0, "DMSO"), (1, "toluene"), (2, "toluene"), (3, "compound 3"), (4, "toluene anhydrous"), (5, None)], "row int, name string")
    d = spark.createDataFrame([("toluene", "Cc1ccccc1", "A", 1), ("toluene", "X", "B", 2)], "lower_name string, smiles string, source string, priority int")
    got = {r["row"]: (r["smiles"], r["source"]) for r in names.resolve_once(occ, d).collect()}
    assert got[0] == ("CS(=O)C", "KnownAlias") and got[1] == got[2] == got[4] == ("Cc1ccccc1", "A") and got[3] == ("[compound 3 (NoSmi)]", None) and got[5] == (None, None) and len(got) == 6


def test_first_pass_order(spark):
    """Ambiguous names are looked up too, the cache comes before the dictionary, and the mark holds the given name."""
    n = spark.createDataFrame([("silica gel",), ("Toluene",), ("dry  toluene",), ("5% odd",), ("x  (dry)",)], "name string")
    d = spark.createDataFrame([("silica gel", "O=[Si]=O", "OPSIN", 1), ("toluene", "D", "OPSIN", 1), ("odd", "CN", "OPSIN", 1)], "lower_name string, smiles string, source string, priority int")
    cache = spark.createDataFrame([("Toluene", "Cc1ccccc1"), ("5% odd", "C1CC"), ("x", "CO"), ("x", "CC")], "name string, smiles string")
    got = {r["name"]: (r["smiles"], r["source"]) for r in names.resolve_names(n, d, cache).collect()}
    assert got["silica gel"] == ("O=[Si]=O", "OPSIN") and got["Toluene"] == ("Cc1ccccc1", "Cache") and got["x  (dry)"] == ("CC", "Cache")
    assert got["5% odd"][1] in ("OPSIN", None)
    assert {r["name"]: r["smiles"] for r in names.resolve_names(n, d.limit(0)).collect()}["x  (dry)"] == "[x  (dry) (NoSmi)]"


def test_usage_by_key(spark):
    rows = [(1, "m", 0, 2, "[Foo-bar (NoSmi)]"), (2, "m", 1, 2, "[foo bar (NoSmi)]"), (2, "n", 0, 1, "[foo  bar (NoSmi)]"), (3, "n", 1, 3, "C"), (3, "n", 1, 3, "[β-x (NoSmi)]"), (4, "m", 0, 2, "[Foo-bar (NoSmi)]")]
    c = spark.createDataFrame(rows, "idx int, model string, pos int, n_sections int, value string")
    got = {r["name_key"]: tuple(r)[1:] for r in names.unresolved_usage(c).collect()}
    assert got == {"foobar": ("Foo-bar", 4, 3, 0, 1, 3, "m:3; n:1", "left:3; product:1"), "betax": ("β-x", 1, 0, 1, 0, 1, "n:1", "middle:1")}
    before = names.unresolved_usage(c)
    o = spark.createDataFrame([("betax", "alias", "y", "u", "n")], "name_key string, kind string, lookup_name string, evidence_url string, note string")
    s = spark.createDataFrame([("foobar", "CC", 3), ("foobar", "C", 5)], "name_key string, smiles string, n long")
    audit = {r["name_key"]: r for r in names.recovery_audit(before, names.unresolved_usage(c.where("idx > 1")), o, s).collect()}
    assert (audit["foobar"]["status"], audit["foobar"]["resolved_smiles"], audit["foobar"]["recovered"]) == ("partially_resolved", "C | CC", 1)
    assert (audit["betax"]["status"], audit["betax"]["override_lookup_name"], audit["betax"]["models"]) == ("not_found", "y", "n:1")


def test_synonyms(spark):
    n = spark.createDataFrame([("bop",), ("aspirin",), ("benzene",)], "name_key string")
    r = spark.createDataFrame([("acetylsalicylicacid", ["aspirin", "bop"], "S1"), ("benzene", ["x"], "S2")], "primary_key string, synonym_keys array<string>, smiles string")
    assert {x["name_key"]: x["smiles"] for x in names.synonym_matches(n, r).collect()} == {"aspirin": "S1", "benzene": "S2"}


def test_override_errors(spark):
    o = spark.createDataFrame([("a", "x", None), ("A", None, "C"), ("b", None, None), (" ", "x", None), ("c", "y", None)], "name string, lookup_name string, smiles string")
    assert {r["name"]: r["problem"] for r in names.override_errors(o).collect()} == {"a": "name is repeated", "A": "name is repeated", "b": "neither lookup_name nor smiles", " ": "no name"}


def test_queue_merge_and_validation(spark):
    q = spark.createDataFrame([("0:x", 2)], "review_id string, occurrences long")
    p = spark.createDataFrame([("0:x", "keep_unresolved", "", "e", ""), ("1:y", "use_smiles", "C", "", ""), ("2:z", " ", "", "", ""), ("3:w", " Pending", "", "", "")], "review_id string, review_decision string, reviewed_smiles string, evidence string, review_note string")
    got = {r["review_id"]: (r["occurrences"], r["currently_unresolved"], r["review_decision"]) for r in review.merge_queue(q, p).collect()}
    assert got == {"0:x": (2, True, "keep_unresolved"), "1:y": (0, False, "use_smiles"), "2:z": (0, False, " ")}


def test_pending_rows(spark):
    rows = spark.createDataFrame([(0, "t", "p"), (1, "t", "p"), (2, "t", "p")], "idx int, title string, paragraph string")
    ck = spark.createDataFrame([(0, "t", "p", "{}", None), (1, "other", "p", "{}", None)], "idx int, title string, paragraph string, prediction string, error string")
    assert {r["idx"]: r["reason"] for r in review.pending_rows(rows, ck).collect()} == {1: "other text", 2: "missing"}


def test_chat_records(spark):
    t = spark.createDataFrame([(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", '"{\\"a\\": 1}"'), (2, 0, "user", "u")], "conv_id int, turn int, role string, text string")
    got = {r["conv_id"]: (r["error"], r["target"]) for r in finetune.convert(finetune.assemble(t)).collect()}
    assert got == {1: (None, '{"a":1}'), 2: ("not three messages", None)}


def test_best_of_families(spark):
    from rxncurate.operators import score

    rows = [("original", 0.378), ("gpt-5.4-low", 0.8375), ("gpt-5.4-none", 0.8375), ("gpt-5.4-high", 0.7), ("gemini-3.6-flash-high", 0.8657), ("gemini-3.6-flash-low", 0.8), ("other", 0.99)]
    df = spark.createDataFrame(rows, "method string, accuracy double")
    assert [(r["method"], r["effort"]) for r in score.best_of_families(df, "original").collect()] == [("original", None), ("gpt-5.4-none", 0), ("gemini-3.6-flash-high", 2)]


def test_risk_reasons(spark):
    from rxncurate.operators import audit

    df = spark.range(2).select("id", *[F.lit(0).alias(c) for c in ("invalid_smiles_count", "duplicate_atom_maps", "atom_element_mismatch", "role_assignment_unmatched_components", "role_overlap_count", "product_reactant_overlap_count", "product_reagent_overlap_count", "multistep_model_count", "product_count")],
        *[F.lit(False).alias(c) for c in ("element_deficit_flag", "reagent_contributes_to_product", "noncontributing_reactant", "no_detectable_transformation", "large_reaction_center", "identical_reactant_product")],
        *[F.lit(True).alias(c) for c in ("product_mapping_complete", "mapping_confident")], F.lit(None).cast("string").alias("mapping_error"), F.lit("a>>b").alias("mapped_reaction"), F.lit("t").alias("mapping_template"), F.col("id").alias("relaxed_model_support_count"))
    got = {r["id"]: (r["risk_level"], r["risk_reasons"]) for r in audit.risk_levels(df).collect()}
    assert got == {0: ("manual_review", "validated ground truth has no model support"), 1: ("pass", "")}
