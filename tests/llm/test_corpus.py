"""Operators that SQL cannot express, and the pipeline, against plain Python."""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from rxncurate.llm import common, exact_dedup, jaccard_join, mixing, ppm, quality, surrogates, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(t):
    return re.sub("[A-Z]+", lambda m: m.group().lower(), t or "")


def test_surrogates_keep_entities_apart_and_together(spark):
    rng = random.Random(3)
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    letters = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    made = {
        "email": lambda: f"{letters(4)}{digits(2)}@{letters(5)}.com", "ip": lambda: ".".join(str(rng.randrange(1, 255)) for _ in range(4)), "card": lambda: str(rng.randrange(1, 10)) + digits(15),
        "ssn": lambda: f"{digits(3)}-{digits(2)}-{digits(4)}", "phone": lambda: f"{rng.randrange(200, 999)}-555-{digits(4)}", "ipv6": lambda: f"2001:db8::{rng.randrange(1, 65535):x}:{rng.randrange(1, 65535):x}",
        "secret": lambda: f'token = "{rng.randrange(16**40):040x}"'}
    entities = [(k, f()) for k, f in made.items() for _ in range(150)]
    texts = [f"word {rng.choice(['one', 'two'])} {v} end" for _, v in entities for _ in range(2)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    table = surrogates.entity_table(df, b"k")
    assert surrogates.collisions(table).count() == 0
    rows = table.collect()
    assert {r["kind"] for r in rows} >= set(made) - {"secret"} and all(r["entity"] != r["surrogate"] for r in rows)
    # The same entity has one surrogate in every document, and different ones have different surrogates.
    bare = lambda v: re.sub(r"[\s().-]", "", v).lower()
    by_entity, by_surrogate = defaultdict(set), defaultdict(set)
    for r in rows:
        by_entity[r["kind"], bare(r["entity"])].add(bare(r["surrogate"]))
        by_surrogate[r["kind"], bare(r["surrogate"])].add(bare(r["entity"]))
    assert all(len(v) == 1 for v in by_entity.values()) and all(len(v) == 1 for v in by_surrogate.values())
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(df, b"k").collect()}
    for i, t in enumerate(texts):
        assert got[i] != t and re.sub(r"[0-9a-f:.@\"=_]+", "", got[i]).split()[:2] == re.sub(r"[0-9a-f:.@\"=_]+", "", t).split()[:2]
    clash = spark.createDataFrame([("email", "a@b.c", "x"), ("email", "d@b.c", "x"), ("ip", "1", "x")], "kind string, entity string, surrogate string")
    assert surrogates.collisions(clash).count() == 1


def test_names_repeat_and_versions_stay(spark):
    texts = ["John Smith's dog bit Smith. SMITH sued.", "Dr Anneke Novak met Ms Anneke Novak.", "Contact: Priya Patel. Patel called.", "Build 1.2.3.4 and version 4.3.2.1 of v1.2.3.4", "Mr " + "x " * 5000 + "Miss Novak"]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k").collect()}
    john, smith, again, loud = re.fullmatch(r"(\w+) (\w+)'s dog bit (\w+)\. (\w+) sued\.", got[0]).groups()
    assert smith == again and loud == smith.upper() and john != "John" and smith != "Smith"
    one, two, three, four = re.fullmatch(r"Dr (\w+) (\w+) met Ms (\w+) (\w+)\.", got[1]).groups()
    assert (one, two) == (three, four) and one != "Anneke" and got[4].endswith(f"Miss {two}")
    assert not re.search("Priya|Patel", got[2]) and got[3] == texts[3]


def test_ftrl_against_scalar_code():
    rng = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    rows = [(" ".join(rng.choice(words) for _ in range(rng.randrange(0, 30))), float(rng.random() < 0.4)) for _ in range(120)]
    rows += [("bad awful bad w1", 1.0)] * 20
    size, hasher = 512, toxicity.Hasher(512)
    z, n = [0.0] * (size + 1), [0.0] * (size + 1)

    def weight(i):
        limit = 0.0 if i == size else toxicity.L1
        if abs(z[i]) <= limit:
            return 0.0
        return -(z[i] - math.copysign(limit, z[i])) / ((toxicity.BETA + math.sqrt(n[i])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(2):
        for t, y in rows:
            own = sorted(set(hasher(t).tolist())) + [size]
            w = [weight(i) for i in own]
            g = 1 / (1 + math.exp(-sum(w))) - y
            for i, wi in zip(own, w):
                z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / toxicity.ALPHA * wi
                n[i] += g * g
    want = {(-1 if i == size else i): weight(i) for i in range(size + 1) if weight(i)}
    batches = [pd.DataFrame(rows[:50], columns=["t", "y"]), pd.DataFrame(rows[50:], columns=["t", "y"])]
    got = toxicity.train(iter(batches), epochs=2, dimensions=size)
    assert set(got["feature"]) == set(want) and len(want) > 2
    assert all(abs(want[f] - w) < 1e-9 for f, w in zip(got["feature"], got["weight"]))


def test_training_sample_is_bounded(spark):
    docs = spark.createDataFrame([(1, f"text {i}") for i in range(50)] + [(2, "other"), (None, "x"), (3, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, 0), (3, 0), (None, 1)], "doc_id long, toxic int")
    seen = toxicity.fit(docs, labels, max_train=10, held_out=(1, 5)).collect()
    assert all(r["feature"] >= -1 for r in seen)
    assert toxicity.drop_toxic(docs.limit(0), labels).count() == 0


def test_quality_against_plain_counts(spark, odd, odd_rows):
    buckets = 64
    trusted = [i for i in (r[0] for r in odd_rows) if i is not None and i % 3 == 0]
    seed = 42

    def grams(t):
        one = [xxhash.xxh64_intdigest(w.encode(), seed) for w in WORD.findall(t or "")]
        pack = lambda x: x.to_bytes(8, "little")
        two = [xxhash.xxh64_intdigest(pack(b), xxhash.xxh64_intdigest(pack(a), seed)) for a, b in zip(one, one[1:])]
        signed = lambda x: x - 2**64 if x >= 2**63 else x
        return [signed(x) % buckets for x in one + two]

    t, n = Counter(), Counter()
    for r in odd_rows:
        for g in grams(r[1]):
            n[g] += 1
            t[g] += r[0] in trusted
    total_t, total_n = sum(t.values()), sum(n.values())
    ratio = {g: math.log((t[g] + 1) / (n[g] * total_t / total_n + 1)) for g in range(buckets)}
    want = sorted((str(r[0]), round(sum(ratio[g] for g in gs) / len(gs), 9) if (gs := grams(r[1])) else None) for r in odd_rows)
    marks = spark.createDataFrame([(i,) for i in sorted(set(trusted))], "doc_id long")
    rows = quality.apply_rules(odd, marks, buckets=buckets).collect()
    got = sorted((str(r["doc_id"]), None if r["score"] is None else round(r["score"], 9)) for r in rows)
    key = lambda x: (x[0], x[1] is None, x[1] or 0.0)
    assert sorted(got, key=key) == sorted(want, key=key)
    for r in rows:
        assert r["kept"] == (not r["base_failed"] and r["score"] is not None and r["score"] >= quality.THRESHOLD)


def near_groups(rows, n, percent):
    """Smallest id of each row's component by comparing every pair."""
    sets = []
    for _, t in rows:
        w = WORD.findall(lower(t))
        sets.append({tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i)
    return [least[find(k)] for k in range(len(rows))]


@pytest.mark.parametrize(("n", "percent", "task"), [(4, 85, 400), (5, 80, 1 << 20)])
def test_near_groups_of_edited_copies(spark, n, percent, task):
    """Large groups of copies with many edits, chains of edits, and shared passages; small tasks, so that
    regions go to further levels and to slices."""
    rng = random.Random(n)
    vocabulary = [f"{a}{b}" for a in "bcdfghjkl" for b in ("an", "ol", "ume", "is", "ert")]
    text = lambda k: [rng.choice(vocabulary) for _ in range(k)]
    passage, rows = text(60), []
    for size, edits in ((60, 4), (40, 6)):
        base = text(90)
        for _ in range(size):
            w = list(base)
            for _ in range(rng.randrange(edits)):
                w[rng.randrange(len(w))] = f"e{rng.randrange(30)}"
            rows.append(w)
    chain = text(80)
    for k in range(25):  # each next one differs a little more from the first
        chain = list(chain)
        chain[3 * k % 80] = f"c{k % 7}"
        rows.append(chain)
    rows += [passage + text(rng.randrange(1, 12)) for _ in range(30)] + [text(40) for _ in range(20)]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    rng.shuffle(rows)
    got = {r["doc_id"]: r["component_id"] for r in jaccard_join.near_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), n, percent, task_shingles=task, block_bytes=20_000).collect()}
    assert got == dict(zip([i for i, _ in rows], near_groups(rows, n, percent)))


def test_drop_near_duplicates_edges(spark, odd, empty):
    assert jaccard_join.drop_near_duplicates(empty).count() == 0
    kept = jaccard_join.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {82, 83, 84, None} <= {r["doc_id"] for r in kept.select("doc_id").collect()}
    with pytest.raises(ValueError):
        jaccard_join.near_components(odd, percent=60)


@pytest.fixture(scope="module")
def corpus(spark, odd_rows, tmp_path_factory):
    """Documents and labels as tables of a folder: odd rows, toxic ones, and columns with clashing names."""
    folder = str(tmp_path_factory.mktemp("corpus"))
    rng = random.Random(8)
    rows = list(odd_rows) + [(200 + k, "you awful nasty fool " + " ".join(rng.choice(["see", "the", "tree", "go"]) for _ in range(20)), "en", "s1", 10, "x", "y") for k in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `row` string, `toxicity` string")
    df.repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(r[0], 1, int(r[0] >= 200)) for r in rows if r[0] is not None], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return folder


def test_pipeline_against_plain_stages(spark, corpus):
    docs, labels = spark.read.parquet(f"{corpus}/documents.parquet"), spark.read.parquet(f"{corpus}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["source"]) for r in docs.collect()]
    scores = toxicity.toxicity_scores(docs, labels).collect()
    bad = Counter(r["doc_id"] for r in scores if r["predicted"] == 1)
    assert any(i is not None and i >= 200 for i in bad)
    rows = [r for r in rows if r[0] not in bad]
    last = {}
    for r in rows:
        last[lower(r[1])] = max(last.get(lower(r[1]), -1), -1 if r[0] is None else r[0])
    rows = [r for r in rows if last[lower(r[1])] == (-1 if r[0] is None else r[0])]  # rows of one id and text are ties
    known = [r for r in rows if r[0] is not None]
    groups = dict(zip([r[0] for r in known], near_groups([(r[0], r[1]) for r in known], 5, 80)))
    rows = [r for r in rows if r[0] is None or groups[r[0]] == r[0]]
    stage = spark.createDataFrame(rows, "doc_id long, text string, source string")
    times = Counter()
    for r in mixing.mixed_sizes(stage).collect():
        times[r["doc_id"]] += r["times"]
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = Counter()
    for i, t in {(r[0], r[1]) for r in rows}:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        want[i, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))] += times[i]
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in corpus_pipeline.run(spark, corpus).collect())
    assert got == +want and len(got) > 20


def test_pipeline_stages_keep_columns(spark, corpus):
    docs = spark.read.parquet(f"{corpus}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, corpus).columns == docs.columns, name
        assert stage(spark, docs.limit(0), corpus).count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, docs.limit(0), corpus).count() == 0
    assert exact_dedup.drop_exact_duplicates(docs).count() < docs.count()
    assert docs.where(F.col("text").isNull()).count() == 1


def test_several_blocks_in_a_task(spark, odd, monkeypatch):
    def results():
        near = sorted(map(str, jaccard_join.near_components(odd, block_bytes=3000).collect()))
        scored = [(r["doc_id"], r["n_tokens"], r["n_known"], round(r["score"], 6), round(r["base_score"], 6)) for r in ppm.score_documents(odd, block_bytes=3000).collect()]
        return near, sorted(scored, key=str)

    alone = results()
    monkeypatch.setattr(common, "MOST_TASKS", 3)
    assert results() == alone


def test_blocks_do_not_depend_on_the_split(spark, odd):
    from rxncurate.llm.common import deal

    def blocks(parts):
        dealt, n = deal(odd.repartition(parts), 4000)
        return n, sorted(map(str, dealt.collect()))

    assert blocks(1) == blocks(7) and blocks(1)[0] > 5
    again = spark.createDataFrame([(1, "same text")] * 800 + [(k, f"text {k}") for k in range(50)], "doc_id long, text string").repartition(8)
    dealt, n = deal(again, 600)
    assert dealt.where("doc_id = 1 AND t = 'same text'").select("block").distinct().count() > 3 and n > 8
    with pytest.raises(ValueError, match="dealt other rows"):
        ppm._places(np.array([1, 4]), np.array([4, 5]))
    kind = {"docs": pd.DataFrame({"doc_id": [1], "t": ["hello world"], "held": [True]}), "table": pd.DataFrame({"key": np.array([ppm.word_key(b"\n")]), "value": [0.0], "known": [True]})}
    with pytest.raises(ValueError, match="dealt other rows"):
        ppm._score_block(kind["docs"], kind["table"])
