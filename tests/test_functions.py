"""Column functions against small literals."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rxncurate.functions import answers, checks, jsonfix, literals, names, reactions, stats, structure


def column(spark, values, f, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r["o"] for r in df.select("i", f(F.col("v")).alias("o")).orderBy("i").collect()]


def test_json_decoding(spark):
    twice = '"{\\"a\\": \\"b\\"}"'
    stray = '{"Products": {"A": "(+)\\-tartrate"}}'
    got = column(spark, ['{"a": 1}', twice, stray, "[1]", "", None, '{"a": 1} trailing'], jsonfix.decode_json_object)
    assert got[0] == '{"a": 1}' and got[1] == '{"a": "b"}' and "(+)-tartrate" in got[2] and got[3:] == [None] * 4


def test_brace_repair_and_first_value(spark):
    assert column(spark, ['"a": 1', '{"a": {"b": 1}', '{"a": 1}}'], jsonfix.fix_braces) == ['{"a": 1}', '{"a": {"b": 1}}', '{{"a": 1}}']
    assert column(spark, ['{"r":"first"}\n{"r":"extra"}'], jsonfix.first_json_value) == ['{"r":"first"}']


def test_structured_output(spark):
    good = '{"Reactants": {"A": "x"}, " products ": {"B": "y"}, "Reaction Steps": {"1 (Reaction, mix)": "A->B"}}'
    bad = '{"Reactants": {"A": "x"}, "Products": {"B": "y"}, "Reaction Steps": {"1 (Reaction, mix)": "A B"}}'
    inside = '{"Reactants": {"A": "x"}, "Products": "{\\"B\\": \\"y\\"}", "Reaction Steps": {"1 (Reaction)": "A->B"}}'
    literal = "{' reactants ': {'A': 'x'}, 'PRODUCT': {'B': None}, 'Reaction Steps': {'1 (Reaction)': 'A->B', '2 (Work-up, reaction)': 'B'}}"
    encoded = '"' + good.replace('"', '\\"') + '"'
    assert [tuple(r) for r in column(spark, [good, bad, "no", None, encoded, good[:-1], inside, literal], answers.structured_output)] == [
        (True, 1), (False, 1), (False, 0), (False, 0), (False, 0), (False, 0), (False, 0), (True, 1)]


def test_lists_booleans_prompts(spark):
    assert column(spark, ["['A>B', 'C']", '["x"]', "one", "", None], literals.component_list) == [["A>B", "C"], ["x"], ["one"], [], []]
    assert column(spark, ["Yes", "0", "?", None], jsonfix.parse_bool) == [True, False, False, False]
    assert column(spark, ["T{paragraph}"], lambda c: jsonfix.render_prompt("{title}|{paragraph}", c, F.lit("P"))) == ["TP|P"]


def test_reaction_strings(spark):
    smiles = F.create_map(F.lit("A"), F.lit("CCO"), F.lit("B"), F.lit("O"), F.lit("D"), F.lit("CC=O"))
    assert column(spark, ["A.B>C>D"], lambda c: reactions.substitute_codes(c, smiles)) == ["CCO.O>C>CC=O"]
    assert column(spark, ["CC>CO", "CC>O>CO", "CC>>CO", "CC>O>CN>CO"], lambda c: reactions.mapper_input(c)[0]) == ["CC>>CO", "CC.O>>CO", "CC>>CO", "CC.O.CN>>CO"]
    assert "NoSmi" in column(spark, ["CC>[unknown (NoSmi)]"], lambda c: reactions.mapper_input(c)[1])[0]
    r = column(spark, ["[CH3:1][Br:2].[OH2:3].[Na+:4]>>[CH3:1][OH:3]"], reactions.roles_of_step)[0]
    assert (len(r["reactants"]), len(r["reagents"])) == (2, 1)
    assert column(spark, ["[CH3:1]>>[CH3:1][OH:2]", "[CH3:1]>>[CH3:1]"], reactions.maps_complete) == [False, True]
    assert column(spark, ["A.B>C"], lambda c: reactions.remove_codes(c, F.array(F.lit("A")))) == ["B>C"]
    assert column(spark, ["B>C"], lambda c: reactions.restore_codes(c, F.array(F.lit("Z"), F.lit("A"), F.lit("C")))) == ["B.A.Z>C"]


def test_names(spark):
    assert names.name_key_of("7α-(5-bromopentyl)") == "7alpha5bromopentyl"
    assert column(spark, ["N,N'-carbonyldiimidazole"], names.resolve_alias) == ["1,1'-carbonyldiimidazole"]
    assert column(spark, ["compound 3", "palladium on carbon", "silica gel", "Sephadex LH-20", "irbesartan"], names.is_ambiguous) == [True, True, True, True, False]
    assert column(spark, ["[a  b (NoSmi)]", "CCO"], names.unresolved_name) == ["a b", None]


def test_stats(spark):
    low, high = stats.wilson(F.col("v"), F.lit(283))
    df = spark.createDataFrame([(245,)], "v long").select(F.round(low * 100, 4).alias("l"), F.round(high * 100, 4).alias("h"), stats.interval_text(F.lit(0.75), F.lit(0.5), F.lit(0.9)).alias("t")).first()
    assert tuple(df) == (82.1067, 90.0586, "75.0000 (50.0000–90.0000)")


def test_structure_keys_and_mapper(spark):
    assert column(spark, ["[CH3:1][OH:2]", "C[C@H](O)N", "not-a-structure!"], structure.text_key) == ["CO", "CC(O)N", None]
    df = spark.createDataFrame([("bad",), ("ok",), (None,)], "mapper_rxn string")

    def mapper(batch):
        if "bad" in batch:
            raise ValueError("no map")
        return [f"{b}:1" for b in batch]

    got = {r["mapper_rxn"]: (r["mapped_rxn"], r["mapping_error"]) for r in structure.map_reactions(df.coalesce(1), mapper).collect()}
    assert got == {"bad": (None, "no map"), "ok": ("ok:1", None), None: (None, None)}


def test_checks(spark):
    df = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(ValueError):
        checks.require_columns(df, "x")
    assert [tuple(r) for r in checks.duplicate_keys(df, ["k"]).collect()] == [(1, 2)]


#: A cell, its items and its map (None: it is none), and whether reading it as a list is an error.
CELLS = (
    ("['a', None]", ["a", None], None, False), ("('a', 'b')", ["a", "b"], None, False), ("('a')", ["a"], None, False), ("('a',)", ["a"], None, False), ("()", [], None, False), ("[]", [], None, False),
    ("['it\\'s', \"q\\\"x\"]", ["it's", 'q"x'], None, False), ("{'A': \"4'-x\", 'B': None}", None, {"A": "4'-x", "B": None}, False), ("[1, 2.5, -3, .5, 1.]", ["1", "2.5", "-3", "0.5", "1.0"], None, False),
    ("plain text", ["plain text"], None, False), ("'quoted'", ["quoted"], None, False), ("5", ["5"], None, False), ("['a',]", ["a"], None, False), ("{'a': {'b': 'c'}}", None, {"a": '{"b":"c"}'}, False),
    ('["a", null]', ["a", None], None, False), ("[a]", ["[a]"], None, True), ("['a'", ["['a'"], None, True), ("['\\\\', '\\x41\\n', 'C/C=C\\\\C', 'C\\C']", ["\\", "A\n", "C/C=C\\C", "C\\C"], None, False),
    ("{'k': 1, 'k': 2}", None, {"k": "2"}, False), ("[('x'), ('y',)]", ["x", '["y"]'], None, False), (" ", [], {}, False), (None, [], {}, False), ("['é', '漢', 'a\tb']", ["é", "漢", "a\tb"], None, False))


def test_literals(spark):
    cells = [c[0] for c in CELLS]
    for f, k in ((literals.literal_list, 1), (literals.literal_map, 2)):
        got = column(spark, cells, f)
        assert [g for g, c in zip(got, CELLS) if c[k] is not None] == [c[k] for c in CELLS if c[k] is not None]
    assert column(spark, cells, lambda c: literals.list_error(c).isNotNull()) == [c[3] for c in CELLS]
    assert column(spark, ["{'a': 1}", "['a']", "", "{'a'"], literals.map_error) == [None, literals.NOT_LITERAL, None, literals.NOT_LITERAL]
    assert column(spark, ["['a', None, ' ', 'b ']", "None", "('c', 'd')"], literals.component_list) == [["a", "None", "b"], ["None"], ["c", "d"]]


def test_charges_and_maps_of_bracket_atoms(spark):
    texts = {"[Fe+2]": (2, 0), "[O--:3]": (-2, 3), "[N+:12]": (1, 12), "[CH3:1]": (0, 1), "C": (0, 0), "[C+0]": (0, 0), "[C:99999999999]": (0, 0)}
    df = spark.createDataFrame([(t,) for t in texts], "c string").withColumn("s", structure.read(F.col("c")))
    assert {r["c"]: (r["s"]["atoms"][0]["charge"], r["s"]["atoms"][0]["map"]) for r in df.collect()} == texts
