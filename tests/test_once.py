"""Work on repeated texts: the same results, once for each text; queries that must not read every row's texts again."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rxncurate.functions import literals
from rxncurate.operators.once import once_each
from rxncurate.operators.structures import readable_keys, structure_table
from rxncurate.plans import structures

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("most", [0, 256])
def test_once_each_agrees_with_the_work_itself(spark, most):
    cells = ["['a', None,]", '["x", "y\\u00e9"]', "('b',)", "(('c'), [1,])", "[", "", "plain", "[1, {'k': ('v',)}]", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, text string")
    found = once_each(df, literals.read_list, most)
    rows = df.select("text", found(F.col("text")).alias("a"), literals.literal_list(F.col("text")).alias("b"), literals.list_error(F.col("text")).alias("c")).collect()
    for r in rows:
        assert (r.a is None) if r.text is None else (r.a["items"], r.a["error"]) == (r.b, r.c)


def test_a_text_that_was_not_given_fails(spark):
    known = spark.createDataFrame([("CC",)], "text string")
    look = once_each(known, F.length)
    assert known.select(look(F.col("text")).alias("n")).collect()[0].n == 2
    with pytest.raises(Exception, match="not among those given"):
        spark.createDataFrame([("CCC",)], "text string").select(look(F.col("text"))).collect()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_literal_cells_reads_each_cell_text_once(spark):
    assert "regexp_extract_all" not in _plan(structures.literal_cells(spark, SF))


def test_structures_are_read_above_the_distinct(spark):
    """A filter on what was read does not go below the distinct, where each row's text would be read."""
    texts = spark.createDataFrame([(t,) for t in ["CCO", "OCC", "C1CC(", "CCO", None]], "text string")
    for df in (structure_table(texts).where("valid"), readable_keys(structure_table(texts))):
        assert not [line for line in _plan(df).splitlines() if "Filter" in line and "regexp_extract_all" in line]
    got = {r["text"]: (r["valid"], r["key"]) for r in readable_keys(structure_table(texts)).collect()}
    assert got == {"CCO": (True, "CCO"), "OCC": (True, "CCO"), "C1CC(": (False, None)}


@pytest.mark.parametrize("name", ["support_of_spellings", "consensus_of_spellings", "metrics_of_spellings"])
def test_queries_of_spellings_read_above_the_distinct(spark, monkeypatch, name):
    """The dimension that a query stores is made of distinct texts."""
    class Seen(Exception):
        pass

    def seen(df):
        raise Seen(_plan(df))

    monkeypatch.setattr(structures, "stored", seen)
    with pytest.raises(Seen) as plan:
        structures.QUERIES[name](spark, SF)
    lines = str(plan.value).splitlines()
    assert any("regexp_extract_all" in line for line in lines)
    assert not [line for line in lines if "Filter" in line and "regexp_extract_all" in line]
