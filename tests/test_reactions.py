"""Reaction strings, steps, consensus, review and files against small literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rxncurate.functions import checks, jsonfix, names, reactions, stats, structure
from rxncurate.operators import audit, consensus, denoise, finetune, mapping_audit, review, score, skeleton, structures
from rxncurate.operators import names as resolving
from rxncurate.sources import files


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("o")).first()["o"]


STEPS = [  # reaction, template missing, mapping error -> failure, maps missing, identical, error
    ("[CH3:1][Br:9].O>CCO>[CH3:1]C", False, "", 1, 1, 0, "product atom mapping is incomplete"),
    ("[CH3:1][OH:2].O>>[CH3:1][OH:2]", False, "", 0, 0, 1, ""),
    ("[CH3:1][OH:2]>C>[OH:2][CH3:1]", True, " boom ", 1, 0, 1, "template extraction failed | boom"),
    ("C(.[CH3:1]>>[CH3:1]", False, "", 1, 0, 1, "invalid SMILES"),
    (">>C", False, "", 1, 1, 0, "missing left-side components | product atom mapping is incomplete | mapped reactants unavailable"),
    ("a>b>c>d", False, "x", 1, 1, 0, "Reaction SMILES must contain two or three sections."),
    ("[CH3:1][H:7]>>[CH3:1]", False, "boom", 1, 0, 1, "boom"),
]


def test_mapped_steps(spark):
    df = spark.createDataFrame([(i, *s[:3]) for i, s in enumerate(STEPS)], "i int, reaction string, template_missing boolean, mapping_error string")
    for r in denoise.step_heuristics(df).collect():
        assert (r["template_failure"], r["missing_product_atom_maps"], r["identical_structures"], r["error"]) == STEPS[r["i"]][3:], r
    counts = denoise.step_heuristics(df).where("i = 0").first()
    assert (counts["reactant_count"], counts["reagent_count"], counts["product_count"], counts["no_reagent"]) == (1, 2, 1, 0)


def test_rows_align_to_the_longest_list(spark):
    schema = "idx int, reactions array<string>, mapped array<string>, templates array<string>, mapping_errors array<string>, issue_rare int, unresolved int"
    rows = [(1, ["a>b>c.d", "x"], ["[CH3:1][OH:2]>C>[OH:2][CH3:1]"], ["T"], [None, "bad", "worse"], 0, 0), (2, [], [], [], [], 0, 1), (3, None, ["[CH3:1].[Br:2]>O>[CH3:1][Br:2]"], ["T"], None, 0, 0)]
    got = {r["idx"]: r for r in denoise.row_heuristics(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["reaction_count"] == 3 and got[1]["evaluation_error"] == "bad | worse" and got[1]["template_failure"] == 1
    assert got[2]["reaction_count"] == 1 and got[2]["evaluation_error"] == "mapped reaction is unavailable" and got[2]["rare_template"] == 1
    assert got[3]["template_failure"] == 0 and got[3]["rare_template"] == 0 and got[3]["max_reactant_count"] == 2


def test_valid_texts(spark):
    got = {v: [one(spark, v, f) for f in (reactions.valid_skeleton, lambda c: reactions.valid_reaction(c), lambda c: reactions.valid_reaction(c, True))] for v in ("A.B>C", "A>x(NoSmi)", "A>not_found", ">B", "[C:1]>>[C:1]", "[C:1]>>C", "A")}
    assert got == {"A.B>C": [True, True, False], "A>x(NoSmi)": [True, False, False], "A>not_found": [True, False, False], ">B": [False, False, False], "[C:1]>>[C:1]": [True, True, True], "[C:1]>>C": [True, True, False], "A": [False, False, False]}


def test_mapped_components_of_several_reactions(spark):
    r = one(spark, ["[CH3:1][OH:2].O>>[OH:2][CH3:1]", "[CH3:1](.[Br:2]>>[Br:2]"], lambda c: reactions.mapped_components(c), "array<string>")
    assert r["reactants"] == ["[CH3][OH]", "[Br]"] and r["reagents"] == ["O"] and r["mapped_products"] == ["[OH:2][CH3:1]", "[Br:2]"] and r["complete"] is False
    assert one(spark, ["[C:1]>>[C:1]"], lambda c: reactions.mapped_components(c), "array<string>")["complete"] is True
    assert one(spark, "[C:1][O:2]", reactions.remove_maps) == "[C][O]"


def test_display_and_codes(spark):
    smiles = F.create_map(F.lit("A"), F.lit("CC"), F.lit("P"), F.lit("[x (NoSmi)]"), F.lit("Q"), F.lit("[y (nosmi)]"))
    assert one(spark, "A.P>", lambda c: reactions.label_unresolved(c, smiles, F.array(F.lit("Q"), F.lit("P"), F.lit("A")))) == "A.P(NoSmi)>P(NoSmi).Q(NoSmi)"
    assert one(spark, ["A.P(NoSmi)>B", "B>>C"], reactions.skeleton_codes, "array<string>") == ["A", "P", "B", "C"]
    assert one(spark, ["A", "P", "Z"], lambda c: names.unresolved_codes(smiles, c), "array<string>") == ["P"]
    sign = lambda rs: one(spark, rs, lambda c: reactions.reaction_signature(c, structure.structure_key), "array<string>")
    assert sign(["CO.N>>C", "C>O>N"]) == sign(["C>[OH2:4]>N", "N.OC>C"]) and sign(["CO.N>>C"]) != sign(["CO>>C"])
    assert sign(["C>>"]) is sign(["C>>N", "x>>N"]) is sign([]) is sign(["C"]) is None
    assert one(spark, ["x", "y", "x2"], lambda c: reactions.first_by_key(c, F.array(F.lit(1), F.lit(2), F.lit(1))), "array<string>") == ["x", "y"]


#: Texts of one structure each line, in the key that ignores charges.
ALIKE = (
    ("OC", "CO", "[CH3:1][OH:2]", "[13CH3][O-]"), ("CCO", "OCC", "C(O)C"), ("COC",), ("C1CC1C", "CC1CC1"), ("c1ccccc1C", "Cc1ccccc1", "c1c(C)cccc1"), ("[se]1cccc1",), ("s1cccc1",),
    ("[Na+].[Cl-]", "[Cl-].[Na+]"), ("[Na+]", "[Na]"), ("N", "[NH4+]"), ("C", "[H]C"), ("CC",), ("C=C",), ("C1CCCCC1", "C%10CCCCC%10"), ("C1CC1.C", "C.C1CC1"),
    # The same neighbours everywhere, yet different rings.
    ("C1CCCCC1.C1CCCCC1",), ("C1CCCCCCCCCCC1",), ("C1CCC2CCCCC2C1", "C12CCCCC1CCCC2"), ("C1CCC(C1)C2CCCC2", "C1CCCC1C1CCCC1"), ("c1ccc2ccccc2c1",), ("C/C=C/C", "CC=CC"), ("C[C@H](O)N", "CC(N)O"))
UNREADABLE = ("C(", "C)", "C1CC", "[Xx]", "C==C", "=C", "C%", "", None, "C C", "CC=", "hello", "CCQ", "C)C(", "[Zz]", "C()C", "C11", "C1C1", "(C)", "C..C", ".C", "C.", "1CC1", "[CH3:1")


def test_structure_keys(spark):
    df = spark.createDataFrame([(k, t) for k, line in enumerate(ALIKE) for t in line], "k int, t string")
    got = df.select("k", "t", structure.looks_valid(F.col("t")).alias("v"), structure.structure_key(F.col("t")).alias("key"), structure.structure_key(F.col("t"), True).alias("strict")).collect()
    assert all(r["v"] and r["key"] for r in got)
    assert len({(r["k"], r["key"]) for r in got}) == len({r["key"] for r in got}) == len(ALIKE)
    strict = {r["t"]: r["strict"] for r in got}
    assert strict["[Na+]"] != strict["[Na]"] and strict["OC"] == strict["[CH3:1][OH:2]"] != strict["[13CH3][O-]"]


def test_unreadable_structures(spark):
    df = spark.createDataFrame([(t,) for t in UNREADABLE], "t string")
    got = df.select(structure.looks_valid(F.col("t")).alias("v"), structure.read(F.col("t")).alias("s"), structure.structure_key(F.col("t")).alias("key")).collect()
    assert not any(r["v"] or r["s"]["valid"] or r["key"] or r["s"]["atoms"] for r in got)
    long = spark.range(1).select(F.repeat(F.lit("C(=O)N"), 500).alias("t")).select(structure.looks_valid(F.col("t")), F.size(structure.read(F.col("t"))["atoms"])).first()
    assert tuple(long) == (True, 1500)


def test_structures_are_read_once_and_joined(spark):
    df = spark.createDataFrame([("OC",), ("CO",), ("OC",), (None,)], "smiles string")
    assert sorted((r["smiles"] or "", r["valid"], r["heavy_atoms"]) for r in structure.read_structures(df, "smiles").collect()) == [("", False, 0), ("CO", True, 2), ("OC", True, 2)]
    keyed = structure.with_structure_key(df, "smiles", keyer=lambda c: "".join(sorted(c)))
    assert keyed.count() == 4 and keyed.where("structure_key IS NOT NULL").select("structure_key").distinct().count() == 1


def test_reaction_centre_from_texts(spark):
    rows = [(1, "input", "[CH3:1][Br:2]"), (1, "input", "[OH-:3]"), (1, "product", "[CH3:1][OH:3]"), (2, "input", "[CH3:1][OH:2]"), (2, "product", "[CH3:1][OH:2]")]
    atoms, bonds = audit.structure_parts(spark.createDataFrame(rows, "rxn_id int, side string, smiles string"))
    got = {r["rxn_id"]: r for r in audit.reaction_centre(atoms, bonds).collect()}
    assert (got[1]["formed_bonds"], got[1]["broken_bonds"], got[1]["leaving_group_bonds"], got[1]["atom_charge_changes"], got[1]["centre_size"]) == (1, 1, 1, 1, 3)
    assert got[2]["no_detectable_transformation"] and not got[1]["large_reaction_center"]
    counts = audit.element_counts(spark.createDataFrame([(1, "input", "[se:1]1cccc1.[as]Cl")], "rxn_id int, side string, smiles string"))
    assert {r["element"]: r["n"] for r in counts.collect()} == {"Se": 1, "C": 4, "As": 1, "Cl": 1}


def test_consensus_without_signatures(spark):
    rows = [(1, "a", 0, None), (1, "b", 1, None), (1, "c", 2, "X"), (2, "a", 0, None), (2, "b", 1, None), (3, "a", 0, "Y"), (3, "b", 1, "X"), (3, "c", 2, "X"), (3, "d", 3, "Y")]
    sigs = spark.createDataFrame(rows, "idx int, model string, model_pos int, signature string")
    agreed = consensus.consensus(sigs)
    got = {r["idx"]: r for r in agreed.collect()}
    assert (got[1]["signature"], got[1]["agreement"], got[1]["disagreeing"]) == ("X", 1, ["a", "b"])
    assert (got[2]["signature"], got[2]["agreement"], got[2]["disagreeing"], got[2]["groups"]) == (None, 0, ["a", "b"], [])
    assert got[3]["members"] == ["a", "d"] and got[3]["groups"] == [["a", "d"], ["b", "c"]]
    mapped, rare = sigs.select("idx", "model", F.lit(1).alias("complete")), sigs.select("idx").limit(0)
    assert {r["idx"]: r["manual_review"] for r in consensus.manual_review(agreed, mapped, rare, least=1).collect()} == {1: 0, 2: 1, 3: 0}
    source = spark.createDataFrame([(1, "X"), (2, "Z"), (3, "X")], "idx int, signature string")
    both = {r["idx"]: (r["comparison_groups"], r["comparison_disagreeing"]) for r in consensus.with_source(agreed, sigs, source).collect()}
    assert both == {1: ([["c", "Lowe_smiles"]], []), 2: ([["Lowe_smiles"]], []), 3: ([["b", "c", "Lowe_smiles"], ["a", "d"]], ["a", "d"])}


def test_model_rows(spark):
    schema = "idx int, model string, smiles map<string,string>, skeletons array<string>, reactions array<string>, mapped array<string>, mapping_errors array<string>"
    rows = [(1, "m", {"A": "C"}, ["A>B"], ["C>O"], ["[CH3:1][OH:2].O>>[OH:2][CH3:1].[CH3:1][OH:2]"], [None]), (2, "m", {"A": "[x (NoSmi)]"}, ["A>B"], ["x"], ["[C:1]>>[C:1]"], []), (3, "m", {}, [], ["x", "y"], ["[C:1]>>[C:1]"], ["e"])]
    got = {r["idx"]: r for r in consensus.model_rows(spark.createDataFrame(rows, schema)).collect()}
    assert got[1]["complete"] == 1 and got[1]["products"] == ["[OH][CH3]"] and got[1]["signature"].count(">") == 2 and got[2]["signature"] is None and got[2]["unresolved"] == ["A"] and got[3]["complete"] == 0


def test_review_decisions(spark):
    schema = "review_id string, idx int, name_key string, review_decision string, reviewed_smiles string, sides string, model_codes string"
    rows = [("a", 1, "x", "USE_smiles", "CC", "left:2", "m1:A|B; m2:C"), ("b", 1, "y", "exclude_from_mapping", "", "left:1", "m1:D"), ("c", 2, "x", "use_smiles", " ", "product:1", "m1:A"), ("d", 2, "z", "approve", "", "", ""), ("e", 3, "x", None, "", "", ""),
            ("f", 4, "w", "use_smiles", "C", "left:1", "m1:A"), ("g", 4, "w", "use_smiles", "CC", "left:1", "m1:A")]
    r = spark.createDataFrame(rows, schema)
    assert not {x["review_id"] for x in review.decision_problems(r.where("idx = 4").withColumn("reviewed_smiles", F.when(F.col("review_id") == "f", "CO").otherwise("OC"))).collect()}
    assert {x["review_id"]: x["problem"] for x in review.decision_problems(r).collect()} == {"c": "reviewed_smiles is not valid SMILES", "d": "unknown decision", "f": "conflicting approved SMILES", "g": "conflicting approved SMILES"}
    assert {(x["idx"], x["model"], x["code"]) for x in review.approved_codes(r.where("idx < 4")).collect()} == {(1, "m1", "A"), (1, "m1", "B"), (1, "m2", "C")}
    assert {x["decision"]: x["rows"] for x in review.decision_counts(r).collect()} == {"use_smiles": 4, "exclude_from_mapping": 1, "pending": 1}
    q = spark.createDataFrame([("row-2__x", 2, "b", True, 5), ("row-10__x", 10, "a", True, 5), ("row-1__y", 1, "c", False, 9)], "review_id string, idx int, display_name string, currently_unresolved boolean, occurrences long")
    assert [x["idx"] for x in review.ordered_queue(q).collect()] == [2, 10, 1]


def test_two_spellings_agree(spark):
    """Models that write a molecule differently have one signature; so does the source's own reaction."""
    schema = "idx int, model string, model_pos int, smiles map<string,string>, skeletons array<string>, reactions array<string>, mapped array<string>, mapping_errors array<string>"
    mapped = ("[CH3:1][CH2:2]Br.[OH2:3]>>[CH3:1][CH2:2][OH:3]", "O[Na].[OH2:3].Br[CH2:2][CH3:1]>>[OH:3][CH2:2][CH3:1]", "[CH3:1][CH2:2]Br.[OH2:3]>>[CH3:1][O:3][CH3:2]", "C1[CH2:1].[OH2:3]>>[CH3:1][OH:3]")
    rows = [(1, f"m{k}", k, {}, ["A>B"], ["A>B"], [m], [None]) for k, m in enumerate((mapped[0], mapped[1].replace("O[Na].", ""), mapped[2]))] + [(2, "m0", 0, {}, ["A>B"], ["A>B"], [mapped[3]], [None])]
    made = consensus.model_rows(spark.createDataFrame(rows, schema))
    agreed = {r["idx"]: r for r in consensus.consensus(made.select("idx", "model", "model_pos", "signature")).collect()}
    assert agreed[1]["members"] == ["m0", "m1"] and agreed[1]["disagreeing"] == ["m2"]
    own = spark.createDataFrame([(1, "Br[CH2:1][CH3:2].[OH2:5]>>[CH3:2][CH2:1][OH:5] |f:1|"), (2, "[CH3:1]>>[CH3:1]"), (3, "C1>>[CH3:1]"), (4, "C>>C>C"), (5, "C>>C")], "idx int, rxn string")
    signed = {r["idx"]: r["signature"] for r in consensus.source_signatures(own, "rxn").collect()}
    assert signed[1] == agreed[1]["signature"] and signed[2] and signed[3] is signed[4] is signed[5] is None


def test_component_signatures(spark):
    rows = [(1, ["CO", "CO"], ["[Na+]"], ["CC"]), (2, ["OC", "[CH3][OH]"], ["[Na+]", "[Na]"], ["CC", "C-C"]), (3, ["CO"], [], ["CC"]), (4, ["CO"], [], []), (5, ["C1C"], None, ["CC"])]
    df = spark.createDataFrame(rows, "idx int, reactants array<string>, reagents array<string>, products array<string>")
    got = {r["idx"]: r for r in structures.component_signatures(df, ["idx"]).collect()}
    assert got[1]["signature"] == got[2]["signature"] != got[3]["signature"] and got[4]["signature"] is got[5]["signature"] is None
    assert got[5]["reactants_keys"] == ["__invalid__:C1C"] and got[1]["reactants_keys"] == got[2]["reactants_keys"]


def test_dimension_takes_unseen_texts(spark, tmp_path):
    path = f"{tmp_path}/d"
    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    first = structures.refresh_structures(spark, path, texts("CO", "CO", "OC", "C(", None))
    assert {r["text"]: r["valid"] for r in first.collect()} == {"CO": True, "OC": True, "C(": False}
    both = structures.refresh_structures(spark, path, texts("CO", "N"))
    assert both.count() == 4 and both.select("key").distinct().count() == 3 and structures.structure_table(texts("CO"), both).count() == 0
    rows = spark.createDataFrame([(1, ["CO", "N"]), (2, ["OC", "C("]), (3, [])], "id int, parts array<string>")
    keyed = {r["id"]: r["structure_keys"] for r in structures.with_key_map(rows, ["id"], ["parts"], both).collect()}
    assert keyed[1]["CO"] == keyed[2]["OC"] and keyed[2]["C("] is None and keyed[3] == {}


def test_step_of_one_molecule_written_twice(spark):
    step = lambda r: one(spark, r, lambda c: denoise.mapped_step(c, F.lit(False), F.lit("")))
    assert step("[CH3:1][OH:2]>>[OH:2][CH3:1]")["identical_structures"] == 1 and step("[CH3:1][OH:2]>>[OH:2][CH2:1]C")["identical_structures"] == 0
    assert step("[CH3:1][OH:2]C>>[OH:2][CH2:1]C")["identical_structures"] == 0 and step("[CH3:1](>>[CH3:1]")["error"].endswith("invalid SMILES | mapped reactants unavailable")


def test_roles_of_unreadable_components(spark):
    got = one(spark, "[CH3:1].[CH3:1](.[OH2:2]>[NH3:3]>[CH3:1].[OH2:2](", reactions.roles_of_source)
    assert (got["reactants"], got["reagents"], got["products"]) == (["[CH3:1]"], ["[CH3:1](", "[OH2:2]", "[NH3:3]"], ["[CH3:1]", "[OH2:2]("])


def test_audit_of_strings(spark):
    rows = [
        (1, "CBr.O>[Na+]>OC", "[CH3:1][Br:2].[OH2:3].[Na+]>>[CH3:1][OH:3]"), (2, "CO>>CO", "[CH3:1][OH:2]>>[CH3:1][OH:2]"), (3, "CBr.O>>CO", "bad"), (4, "C1CC>>CO", "[CH3:1]>>[CH3:1]C("),
        (5, "C.N>O>CN", "[CH4:1].[NH3:2].[OH2:3]>>[CH3:1][NH2:2][CH3:1]"), (6, "C>>C>>C", None), (7, "CO.N>>CON", "[CH3:1][OH:2].C>>[CH3:1][NH:2]O"), (8, "C.[O-]>>CCl", "[CH4:1].[OH-:2].[H:9]>>[CH3:1][Cl:2][H:9]"),
        (9, "O.CC>CN>CC.O", "[OH2:1].[CH3:2][CH3:3].[CH3:4][NH2:5]>>[CH2:2]=[CH2:3].[OH2:1].[CH3:4]")]
    df = spark.createDataFrame([(*r, "kept") for r in rows], "idx int, reaction_smiles string, mapped_reaction string, title string")
    got = {r["idx"]: r.asDict() for r in mapping_audit.audit_reactions(df, ["idx"]).collect()}
    told = lambda k: {c: v for c, v in got[k].items() if c in (*mapping_audit.COUNTS, *mapping_audit.FLAGS, "element_deficit", "invalid_smiles") and v and v != "{}"}
    assert told(1) == {"product_mapping_complete": True, "leaving_group_bonds": 1, "formed_bonds": 1, "broken_bonds": 1} and got[1]["mapping_detail"] == "" and got[1]["title"] == "kept"
    assert told(2) == {"product_mapping_complete": True, "no_detectable_transformation": True} and got[2]["identical_reactant_product"] and got[2]["product_reactant_overlap_count"] == 1
    assert told(3) == {} and got[3]["mapping_detail"] == "invalid mapped reaction format" and got[4]["mapping_detail"] == "invalid or empty mapped structure" and told(4) == {"invalid_smiles": "C1CC"}
    assert told(5) == {"duplicate_atom_maps": 1, "formed_bonds": 1} and got[5]["mapping_detail"] == "incomplete product atom mapping; duplicate atom-map numbers"
    assert got[6]["invalid_smiles_count"] == 1 and got[6]["label_error"] and not got[6]["identical_reactant_product"]
    assert told(7) == {"atom_element_mismatch": 1, "role_assignment_unmatched_components": 2, "no_detectable_transformation": True}
    assert got[8]["element_deficit"] == '{"Cl": 1}' and got[8]["element_deficit_flag"] and told(8)["atom_element_mismatch"] == 1 and told(8)["atom_charge_changes"] == 1 and told(8)["product_mapping_complete"]
    assert told(9) == {"product_mapping_complete": True, "reagent_contributes_to_product": 1, "bond_order_changes": 1, "leaving_group_bonds": 1, "broken_bonds": 1} and got[9]["product_reactant_overlap_count"] == 2


def test_manifest(spark):
    schema = "idx int, ground_truth_valid string, signature_1 string, signature_2 string, review_note string"
    rows = [(1, "True", "A", "B", None), (2, "yes", "A", None, "x"), (3, "0", "A", "B", "bad scan")]
    got = {r["idx"]: (r["ground_truth_valid"], r["ground_truth_source"], r["alternatives"], r["ground_truth_count"]) for r in score.ground_truth_manifest(spark.createDataFrame(rows, schema)).collect()}
    assert got == {1: (True, "human_validated", ["A", "B"], 2), 2: (True, "human_validated", ["A"], 1), 3: (False, "no_valid_ground_truth", [], 0)}
    for bad, text in ((("4", "True", None, "B", ""), "no signature: 4"), (("1", "False", None, None, ""), "repeated"), (("4", "maybe", "A", None, ""), "not a boolean"), (("4", None, "A", None, ""), "boolean|label")):
        with pytest.raises(Exception, match=text):
            score.ground_truth_manifest(spark.createDataFrame([*rows, (int(bad[0]), *bad[1:])], schema)).collect()


def test_coverage_and_excluded_rows(spark):
    truth = spark.createDataFrame([(1, 1, "products", "P"), (1, 1, "reactants", "A"), (2, 1, "products", "Q")], "rxn_id int, slot int, role string, comp string")
    pred = spark.createDataFrame([(1, "ai", "products", "P", True), (1, "ai", "reactants", "A", False), (1, "ai", "reagents", "X", False), (2, "m", "products", "Q", False)], "rxn_id int, method string, role string, comp string, unresolved boolean")
    compared = score.compare_alternatives(pred, truth, ["ai", "m"])
    wide = {(r["rxn_id"], r["method"]): r["reaction_correct"] for r in score.best_ground_truth(compared, prefer_coverage=True).collect()}
    assert wide == {(1, "ai"): 1, (1, "m"): 0, (2, "ai"): 0, (2, "m"): 1}
    flags = score.best_ground_truth(compared)
    assert {(r["rxn_id"], r["method"]): r["reaction_correct"] for r in flags.collect()} == {(1, "ai"): 0, (1, "m"): 0, (2, "ai"): 0, (2, "m"): 1}
    manifest = spark.createDataFrame([(1, True, ""), (3, False, "no reaction")], "idx int, ground_truth_valid boolean, review_note string")
    every = score.with_excluded(flags, manifest, ["ai", "m"])
    assert {(r["method"], r["exclusion_reason"], r["reaction_correct"]) for r in every.where("evaluation_included = 0").collect()} == {("ai", "no reaction", None), ("m", "no reaction", None)}
    assert {(r["method"], r["evaluated"], r["excluded"]) for r in score.extraction_metrics(every).collect()} == {("ai", 2, 1), ("m", 2, 1)}


def test_arrays_compare_as_rows_do(spark):
    """Components in arrays give what their rows give: repeats, empty roles, a method and a slot that is not there."""
    made = [(1, "a", ["x", "x", "y"], ["s", "s"], ["p"]), (1, "b", ["x"], [], ["p", "q"]), (2, "a", ["__invalid__:C1"], ["s"], ["p"]), (9, "a", ["x"], [], ["p"])]
    asked = [(1, 2, ["x", "x"], ["s"], ["p", "p"]), (1, 1, ["x", "y", "x"], ["s"], ["p"]), (2, 1, ["x"], [], ["p"]), (3, 1, ["x"], [], ["p"])]
    frame = lambda rows, key: spark.createDataFrame(rows, f"rxn_id long, {key}, reactants array<string>, reagents array<string>, products array<string>")
    pred, truth = frame(made, "method string"), frame(asked, "slot int")
    named = lambda r: F.transform(r, lambda c: F.struct(F.lit(r).alias("role"), c.alias("comp")))
    flat = lambda df, key: df.select("rxn_id", key, F.explode(F.concat(*map(named, score.ROLES))).alias("p")).select("rxn_id", key, "p.*")
    rows = score.compare_alternatives(flat(pred, "method").withColumn("unresolved", F.lit(False)), flat(truth, "slot"), ["a", "b"])
    shown = lambda df: sorted(str(r) for r in df.select("rxn_id", "method", "has_unresolved", "alternatives").collect())
    got = score.compare_arrays(pred, truth, ["a", "b"])
    assert shown(got) == shown(rows) and got.count() == 6
    first = {(r["rxn_id"], r["method"]): r["alternatives"][0] for r in got.collect()}[(1, "a")]
    assert first["slot"] == 1 and first["c"]["exact"] == 1 and first["c"]["tp"] == 5


def test_stale_mappings(spark):
    rows = spark.createDataFrame([(1, "m", "x", "y", ""), (2, "m", "x", "y", "")], "idx int, model string, mapped string, template string, mapping_error string")
    got = {r["idx"]: (r["mapped"], r["template"], r["mapping_error"]) for r in review.clear_stale(rows, rows.where("idx = 1"), ["mapped", "template"]).collect()}
    assert got == {1: (None, None, "Human-reviewed SMILES applied; rerun atom mapping."), 2: ("x", "y", "")}


def test_upsert_takes_the_highest_version(spark):
    old, new = spark.createDataFrame([(1, "a", 0), (2, "b", 0)], "idx int, p string, v int"), spark.createDataFrame([(2, "z", 1), (2, "c", 2), (3, "d", 1)], "idx int, p string, v int")
    assert {r["idx"]: r["p"] for r in review.upsert(old, new, version="v").collect()} == {1: "a", 2: "c", 3: "d"}


def test_failing_checks(spark):
    df = spark.createDataFrame([(1, "t", "p")], "idx int, title string, paragraph string")
    good = spark.createDataFrame([(1, "t", "p", "C")], "idx int, title string, paragraph string, ai_x string")
    assert review.attach_baseline(df, good, "ai_").first()["ai_x"] == "C"
    for bad in (good.unionByName(good), good.withColumn("title", F.lit("other")), good.withColumn("idx", F.lit(2))):
        with pytest.raises(Exception, match="baseline"):
            review.attach_baseline(df, bad, "ai_").collect()
    d = spark.createDataFrame([(1, {"A": "C"})], "idx int, smiles map<string,string>")
    assert files.attach_dictionaries(df, d).first()["smiles"] == {"A": "C"}
    for bad in (d.limit(0), d.unionByName(d)):
        with pytest.raises(Exception, match="differ|repeated"):
            files.attach_dictionaries(df, bad).collect()
    with pytest.raises(Exception, match="no audited row"):
        consensus.attach_findings(spark.createDataFrame([(1, 1)], "idx int, slot int"), spark.createDataFrame([(1, 2, "f")], "idx int, slot int, finding string")).collect()
    with pytest.raises(Exception, match="no signature"):
        score.ground_truth_manifest(spark.createDataFrame([(1, True, None, None)], "idx int, ground_truth_valid boolean, signature_1 string, signature_2 string")).collect()
    assert {r["side"] for r in checks.key_mismatches(df, df.withColumn("idx", F.lit(5)), ["idx"]).collect()} == {"left_only", "right_only"}


def test_chat_targets_keep_order(spark):
    text = '"{\\"Reaction Steps\\": {\\"2 (b)\\": \\"x\\", \\"10\\": 1.0, \\"1\\": null}, \\"A\\": \\"é\\"}"'
    assert finetune.compact_target(text) == '{"Reaction Steps":{"2 (b)":"x","10":1.0,"1":null},"A":"é"}'
    assert finetune.compact_target("[1]") is None and finetune.compact_target(None) is None and finetune.compact_target('"\\"\\\\\\"{}\\\\\\"\\""') is None
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "no"), (2, 0, "system", "s"), (2, 1, "user", "u"), (2, 2, "assistant", "{}")]
    made = finetune.convert(finetune.assemble(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")))
    assert {r["conv_id"]: (r["error"], r["target"]) for r in made.collect()} == {1: ("Assistant target is not a JSON object after decoding.", None), 2: (None, "{}")}
    assert tuple(finetune.summary(made).first()) == (2, 1, 1)


def test_second_pass_names(spark):
    n = spark.createDataFrame([("DMSO",), ("silica gel",), ("Toluene",), ("compound 7",), ("odd",)], "name string")
    d = spark.createDataFrame([("toluene", "B", "ChEBI", 4), ("toluene", "A", "PubChem", 1), ("benzene", "Z", "OPSIN", 2)], "lower_name string, smiles string, source string, priority int")
    o = spark.createDataFrame([("compound-7", "benzene", None, None), ("silica  gel", None, "O=[Si]=O", "mineral")], "name string, lookup_name string, smiles string, kind string")
    got = {r["name"]: (r["smiles"], r["source"]) for r in resolving.resolve_missing(n, d, o).collect()}
    assert got == {"DMSO": ("CS(=O)C", "KnownAlias"), "silica gel": ("O=[Si]=O", "Curated:mineral"), "Toluene": ("A", "PubChem"), "compound 7": ("Z", "Curated:alias+OPSIN"), "odd": (None, None)}
    assert one(spark, "CIR", resolving.source_priority) == 3 and one(spark, "x", resolving.source_priority) == 6


def test_whole_answer_job(spark):
    step = "array<struct<step_key string, equation string>>"
    answers = spark.createDataFrame([(1, ["P"], [("1 (Reaction, mix)", "A+B->P")]), (2, ["P"], None), (3, ["P"], [])], f"idx int, products array<string>, steps {step}")
    dictionaries = spark.createDataFrame([(1, {"A": "CC"}), (2, {}), (3, {})], "idx int, smiles map<string,string>")
    got = {r["idx"]: (r["skeletons"], r["reactions"], r["error"]) for r in skeleton.assemble_reactions(answers, dictionaries, ["idx"]).collect()}
    assert got == {1: (["A.B>P"], ["CC.B>P"], None), 2: (None, None, "2 Error: empty rxn_codes"), 3: ([], ["Error: empty rxn_codes"], None)}


def test_files_round_trip(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted",\nline', 0.5)], "idx int, text string, x double")
    files.write_csv(df, f"{tmp_path}/t", {"x": "%.4f"})
    assert tuple(files.read_csv(spark, f"{tmp_path}/t").first()) == ("1", 'a "quoted",\nline', "0.5000")
    chats = spark.createDataFrame([([("system", "s"), ("user", "é")],)], "messages array<struct<role string, content string>>")
    files.write_chat_records(chats, f"{tmp_path}/c")
    back = files.read_chat_records(spark, f"{tmp_path}/c").first()
    assert [tuple(m) for m in back["messages"]] == [("system", "s"), ("user", "é")] and not back["bad"]
    d = spark.createDataFrame([(1, {"A": "C", "B": None})], "idx long, smiles map<string,string>")
    files.write_dictionaries(d, f"{tmp_path}/d")
    assert files.read_dictionaries(spark, f"{tmp_path}/d").first()["smiles"]["A"] == "C"
    (tmp_path / "m1_reaction_smiles_final.csv").write_text("﻿idx,m1_rxn\n1,A>B\n", encoding="utf-8")
    (tmp_path / "m2_reaction_smiles_final.csv").write_text("﻿idx,m1_rxn\n1,A>C\n", encoding="utf-8")
    outputs = files.read_model_outputs(spark, f"{tmp_path}/*_reaction_smiles_final.csv")
    assert {r["model"] for r in outputs.collect()} == {"m1", "m2"}
    assert [r["model"] for r in files.models_without_dictionary(outputs, spark.createDataFrame([("m1",)], "model string")).collect()] == ["m2"]
    (tmp_path / "o.json").write_text('{"overrides": [{"name": "a", "smiles": "C"}]}')
    assert files.read_overrides(spark, f"{tmp_path}/o.json").first()["smiles"] == "C"
    wide = spark.createDataFrame([(1, "a", "b")], "idx int, m1_rxn string, m2_rxn string")
    assert {(r["model"], r["rxn"]) for r in files.to_long(wide, ["idx"], ["m1", "m2"], ["rxn"]).collect()} == {("m1", "a"), ("m2", "b")}
    assert files.infer_reaction_column(["idx", "m_rxn", "m_mapped_rxn"]) == "m_rxn"
    with pytest.raises(ValueError):
        files.infer_reaction_column(["a_rxn", "b_rxn"])


def test_small_expressions(spark):
    assert one(spark, 12.25, stats.one_decimal, "double") == 12.3
    assert one(spark, '{"a": " ", "b": "C("}', lambda c: names.first_property(c, ["a", "b", "c"])) is None and one(spark, '{"a": "C(", "b": "CC"}', lambda c: names.first_property(c, ["a", "b"])) == "CC"
    assert one(spark, ["b", "a", "a"], lambda c: score.signature(c, True), "array<string>") == ["a", "a", "b"] and one(spark, ["b", None], lambda c: score.signature(c, False), "array<string>") is None
    assert one(spark, ["x", None], lambda c: score.prediction_keys(c, F.array(F.lit("t"), F.lit(" u "))), "array<string>") == ["x", "__invalid__:u"]
    assert one(spark, ["a", "b"], lambda c: score.matched_slot(c, F.lit("b")), "array<string>") == 2
    assert one(spark, ["a"], lambda c: score.signature_text(c, c, c), "array<string>") == '{"products":["a"],"reactants":["a"],"reagents":["a"]}'
    assert one(spark, {"a": "b"}, jsonfix.answer_text, "map<string,string>") == '{"a":"b"}'
    assert one(spark, " TRUE", consensus.label_status) == "True" and one(spark, "", consensus.label_status) == "unreviewed"
    manifest = score.ground_truth_manifest(spark.createDataFrame([(1, True, "a", "b"), (2, False, None, None)], "idx int, ground_truth_valid boolean, signature_1 string, signature_2 string"))
    assert {r["idx"]: r["ground_truth_count"] for r in manifest.collect()} == {1: 2, 2: 0}
    flags = spark.createDataFrame([(1, 0), (1, 1), (0, 0)], "a int, b int").withColumn("c", denoise.exclusive_category(["a", "b"]))
    assert [r["c"] for r in flags.collect()] == ["a", None, None]
