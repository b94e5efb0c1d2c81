"""Leaks of evaluation items, stored mappings, resumed checkpoints and checks on a job, against plain Python."""

from __future__ import annotations

import os
import random
import re

import pytest
from pyspark.sql import functions as F

from rxncurate.functions import checks
from rxncurate.operators import checkpoint, containment, mapping_store


def plain_words(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def brute(train, items):
    found = []
    for item, text in items:
        part = plain_words(text)
        for key, body in train:
            words = plain_words(body)
            at = [k for k in range(len(words) - len(part) + 1) if words[k:k + len(part)] == part] if part else []
            if at:
                found.append((item, key, at[0]))
    return sorted(found, key=str)


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_contained_items(spark, monkeypatch, sent):
    monkeypatch.setattr(containment, "SENT", sent)
    rng = random.Random(5)
    word = lambda: rng.choice("ab cd ef gh ij".split())
    train = [(k, " ".join(word() for _ in range(rng.randrange(0, 60)))) for k in range(80)]
    train += [(80, None), (81, ""), (82, "One, TWO-three!  four"), (82, "One, TWO-three!  four"), (None, "one two three"), (84, "x " * 20_000 + "one two three four five six seven eight")]
    train += [(100 + k, "Licence of all, without any warranty of any kind; " + str(k)) for k in range(50)]
    items = [(k, " ".join(word() for _ in range(k % 9))) for k in range(30)]
    items += [(30, "two three"), (31, "one two three four five six seven eight"), (32, None), (33, "!?"), (34, "WITHOUT any warranty of any kind"), (34, "one"), (35, "tw othree"), (36, "no such words in any of them at all")]
    t = spark.createDataFrame(train, "doc_id long, text string").withColumn("_item", F.lit("clash"))
    e = spark.createDataFrame(items, "item_id long, text string")
    got = containment.contained_items(t, e, ["doc_id"])
    rows = sorted(map(tuple, got.collect()), key=str)
    assert rows == brute(train, items) and len(rows) > 100
    counts = containment.containment(got, e.dropDuplicates(["item_id"]))
    assert {r["item_id"]: r["rows_with_item"] for r in counts.collect()} == {i: sum(1 for f in rows if f[0] == i) for i, _ in items}


def test_contained_items_of_empty_tables(spark):
    t, e = spark.createDataFrame([(1, "a b")], "doc_id long, text string"), spark.createDataFrame([(1, "a b")], "item_id long, text string")
    for train, items in ((t.limit(0), e), (t, e.limit(0)), (t, e.withColumn("text", F.lit(None).cast("string")))):
        got = containment.contained_items(train, items, ["doc_id"])
        assert got.columns == ["item_id", "doc_id", "word_at"] and got.collect() == []


def numbering(log):
    def mapper(reactions):
        with open(log, "a") as f:
            f.write("".join(r + "\n" for r in reactions) if len(reactions) == 1 else "")
        if any("Br" in r for r in reactions):
            raise ValueError("bromine")
        return [{} if "I" in r else {"mapped_rxn": r.lower(), "template": None if "N" in r else "T", "confident": "N" in r} for r in reactions]

    return mapper


def test_mapping_columns_by_place(spark, tmp_path):
    path, log = str(tmp_path / "store"), str(tmp_path / "log")
    rows = [
        (1, ["CC>>CO", " C.N>>CN ", "CC>>CO"]), (2, ["CBr>>C", "CC>>CO", "CI>>C"]), (3, []), (4, None), (5, [" ", None]), (6, ["CC", ">>C", "[x (NoSmi)]>>C", "Error: none", "C>O>CO"]), (7, ["late>>C"])]
    df = spark.createDataFrame(rows, "idx long, rxns array<string>").withColumn("m_mapped_rxn", F.lit("stale")).withColumn("place", F.lit(0))
    asked = mapping_store.mapper_inputs(df, ["idx"], "rxns")
    assert mapping_store.read_store(spark, path) is None
    results = mapping_store.refresh_store(spark, path, asked.where("reaction <> 'late>>C'"), numbering(log), batch_size=2)
    out = {r["idx"]: r for r in mapping_store.with_mapping_columns(df, ["idx"], "rxns", results, "m").collect()}
    assert out[1]["m_localmapper_rxn"] == ["CC>>CO", "C.N>>CN", "CC>>CO"] and out[1]["m_mapped_rxn"] == ["cc>>co", "c.n>>cn", "cc>>co"]
    assert out[1]["m_mapping_template"] == ["T", None, "T"] and out[1]["m_mapping_confident"] == [False, True, False] and out[1]["m_mapping_error"] == ["", "", ""]
    assert out[2]["m_mapped_rxn"] == [None, "cc>>co", None]
    assert out[2]["m_mapping_error"] == ["ValueError: bromine", "", "ValueError: LocalMapper returned an invalid result."]
    for k in (3, 4, 5):
        assert out[k]["m_localmapper_rxn"] == [None] and out[k]["m_mapping_error"] == ["Reaction SMILES is empty."]
    assert out[6]["m_mapping_error"] == [
        "Reaction must contain at least one '>' separator between reactants and products.", "Reaction must contain both reactants and products.",
        "Reaction contains an unresolved (NoSmi) compound.", "Error: none", ""]
    assert out[6]["m_localmapper_rxn"][4] == "C.O>>CO" and out[7]["m_mapping_error"] == [None] and out[7]["m_localmapper_rxn"] == ["late>>C"]
    assert out[1]["place"] == 0 and len(out) == len(rows)


def test_only_unseen_reactions_are_mapped(spark, tmp_path):
    path, log = str(tmp_path / "store"), str(tmp_path / "log")
    r = lambda *texts: spark.createDataFrame([(t,) for t in texts], "reaction string").coalesce(1)
    said = lambda: sorted(open(log).read().split()) if os.path.exists(log) else []
    mapping_store.refresh_store(spark, path, r("A>>C", "Br>>C", "A>>C", None), numbering(log), batch_size=1)
    assert said() == ["A>>C", "Br>>C"]
    mapping_store.refresh_store(spark, path, r("A>>C", "Br>>C", "B>>C"), numbering(log), batch_size=1)
    assert said() == ["A>>C", "B>>C", "Br>>C"]
    good = lambda reactions: [{"mapped_rxn": "now", "template": "T", "confident": True} for _ in reactions]
    after = mapping_store.refresh_store(spark, path, r("A>>C", "Br>>C"), good, retry=True)
    assert sorted((x["reaction"], x["mapped_rxn"], x["error"]) for x in after.collect()) == [("A>>C", "a>>c", ""), ("B>>C", "b>>c", ""), ("Br>>C", "now", "")]
    with pytest.raises(ValueError):
        mapping_store.map_distinct(r("A>>C"), good, batch_size=0)


def test_a_mapper_that_answers_too_little(spark):
    got = mapping_store.map_distinct(spark.createDataFrame([("A>>B",), ("C>>D",)], "reaction string").coalesce(1), lambda reactions: [{"mapped_rxn": "m"}])
    assert sorted((r["reaction"], r["mapped_rxn"]) for r in got.collect()) == [("A>>B", "m"), ("C>>D", "m")]


def files(path):
    return {os.path.join(d, f): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(path) for f in names if f.startswith("part-")}


def test_an_update_writes_only_its_buckets(spark, tmp_path):
    path, schema = str(tmp_path / "ck"), "idx long, prediction string, v int"
    df = lambda rows: spark.createDataFrame(rows, schema)
    assert checkpoint.read_checkpoint(spark, path, schema).collect() == [] and not checkpoint.committed(spark, path, "a")
    first = [(k, "old", 0) for k in range(500)] + [(None, "none", 0)]
    checkpoint.apply_update(spark, path, df(first), "a", version="v", buckets=8)
    before = files(path + "/rows")
    written = checkpoint.apply_update(spark, path, df([(7, "new", 1), (7, "newest", 2), (900, "more", 1)]), "b", version="v", buckets=8)
    after = files(path + "/rows")
    assert 1 <= written <= 2 and sum(after.get(f) == t for f, t in before.items()) == len(before) - written
    want = {k: "old" for k, *_ in first} | {7: "newest", 900: "more", None: "none"}
    state = lambda: {r["idx"]: r["prediction"] for r in checkpoint.read_checkpoint(spark, path, schema).collect()}
    assert state() == want and checkpoint.committed(spark, path, "b")
    assert checkpoint.apply_update(spark, path, df([(1, "twice", 9)]), "b", version="v", buckets=8) == 0 and state() == want
    assert checkpoint.apply_update(spark, path, df([]), "c", version="v", buckets=8) == 0 and state() == want
    with pytest.raises(ValueError, match="8 buckets"):
        checkpoint.apply_update(spark, path, df([(1, "x", 1)]), "d", buckets=9)


def test_an_update_cut_short_may_come_again(spark, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "ck"), "idx long, title string, paragraph string, prediction string, error string"
    rows = spark.createDataFrame([(k, "t", "p", "{}" if k % 2 else "", None) for k in range(20)], schema)
    with monkeypatch.context() as m:
        m.setattr(type(spark), "createDataFrame", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            checkpoint.apply_update(spark, path, rows, "a", buckets=4)
    assert not checkpoint.committed(spark, path, "a")
    checkpoint.apply_update(spark, path, rows, "a", buckets=4)
    assert checkpoint.read_checkpoint(spark, path, schema).count() == 20
    asked = spark.createDataFrame([(k, "t", "p" if k else "q") for k in range(22)], "idx long, title string, paragraph string")
    left = {r["idx"]: r["reason"] for r in checkpoint.resume(spark, path, asked, schema).collect()}
    assert left == {k: "no prediction" for k in range(2, 20, 2)} | {0: "other text", 20: "missing", 21: "missing"}


def test_checks_ride_on_the_job(spark, tmp_path):
    df = spark.createDataFrame([(1, 1, 0, 3), (2, 0, 1, 1), (3, 1, 1, 2), (4, None, 1, 1)], "idx int, a int, b int, total int")
    seen = checks.Watched(df, {"flags": checks.complementary(F.col("a"), F.col("b")), "cells": checks.sums_to([F.col("a"), F.col("b")], F.col("total"))})
    seen.rows.write.parquet(str(tmp_path / "t"))
    assert seen.counts() == {"rows": 4, "flags": 2, "cells": 2}
    with pytest.raises(ValueError, match=r"flags: 2 rows; cells: 2 rows; 4 rows instead of 5"):
        seen.verify(rows=5)
    fine = checks.Watched(df.where("idx = 2"), {"flags": checks.complementary(F.col("a"), F.col("b"))})
    fine.rows.write.parquet(str(tmp_path / "u"))
    assert fine.verify(rows=1) == 1
    none = checks.Watched(df.limit(0), {"flags": F.lit(False)})
    none.rows.write.parquet(str(tmp_path / "v"))
    assert none.verify() == 0


def test_one_to_one(spark):
    df = lambda rows, c: spark.createDataFrame(rows, f"idx int, {c} string")
    a = df([(1, "x"), (2, None)], "a")
    assert sorted(map(tuple, checks.one_to_one(a, df([(2, "q"), (1, "p")], "b"), ["idx"]).collect())) == [(1, "x", "p"), (2, None, "q")]
    for other, said in (([(1, "p")], "one side only"), ([(1, "p"), (2, "q"), (2, "r")], "repeated"), ([(1, "p"), (2, "q"), (None, "r")], "null")):
        with pytest.raises(Exception, match=said):
            checks.one_to_one(a, df(other, "b"), ["idx"]).collect()
