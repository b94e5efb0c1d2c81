"""Operators against brute force on small tables with nulls, empty and long texts, ties and repeats."""

from __future__ import annotations

import hashlib
import math
import re
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from rxncurate.llm import bpe, exact_dedup, graph, jaccard_join, mixing, ppm, quality, sharding, surrogates, token_files, toxicity

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def test_surrogates(spark, empty):
    rows = [(1, "Mail Jo.Doe5@acme.co, jo.doe5@acme.co; 97.51.17.173 and +1 (017) 555-7713, +1-017-555-7713"), (2, "Mr Smith met Mary Smith. 4111111111111111 4111-1111-1111-1111 7536784127813050 4845168114407329"),
            (3, None), (4, ""), (5, "clean 2024-01-31 text 12 3.5"), (None, "Mrs Smith"), (6, "GB82 WEST 1234 5698 7654 32 and 123-45-6789")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in surrogates.replace_entities(df, b"k").collect()}
    assert len(got) == 7 and got[3]["text"] is None and got[4]["text"] == "" and got[5]["text"] == rows[4][1]
    first = got[1]["text"]
    assert not re.search("doe|97.51|017", first) and got[1]["n_entities"] == 5
    mails = re.findall(r"\S+@[\w.]+\w", first)
    assert mails[0] == mails[1].rstrip(";")
    phones = [re.sub(r"\D", "", x) for x in re.findall(r"\+[\d ()-]+\d", first)]
    assert phones[0] == phones[1] and phones[0][0] == "1"
    cards = re.findall(r"\d{16}", got[2]["text"])
    assert len(cards) == 3 and surrogates.luhn(cards[0]) and cards[0] == re.search(r"(?:\d{4}-){3}\d{4}", got[2]["text"]).group().replace("-", "")
    names = re.match(r"Mr (\S+) met (\S+) ([^ .]+)\.", got[2]["text"]).groups()
    assert names[0] == names[2] != names[1] and got[None]["text"] == f"Mrs {names[0]}" and "Smith" not in got[2]["text"]
    assert surrogates.replace_entities(empty, b"k").count() == 0


def test_numbers_beside_numbers():
    s = surrogates.Surrogates(b"k")

    def replaced(t):
        out, at = [], 0
        for i, j, _, new in s.find(t):
            out += [t[at:i], new]
            at = j
        return "".join(out) + t[at:]

    phones, ssns = ["555-123-4567", "555-987-6543", "(555) 123-4567", "+1 (171) 555-2028", "+44 20 7946 0958"], ["123-45-6789", "987-65-4321"]
    alone = {x: replaced(x) for x in phones + ssns}
    assert all(a != b and re.sub(r"\d", "0", a) == re.sub(r"\d", "0", b) for a, b in alone.items())
    for x in alone:
        for form in ("In 2019 {}", "on May 5. {}", "room 12 {}", "{}. 20 items", "{}, 3", "{} 2024-01-31"):
            assert replaced(form.format(x)) == form.format(alone[x])
        for y in alone:
            assert replaced(f"{x} {y}") == f"{alone[x]} {alone[y]}"
    national = [re.sub(r"\D", "", replaced(x))[-10:] for x in ("+15551234567", "+1 555 123 4567", "1-555-123-4567", "(555) 123-4567")]
    assert len(set(national)) == 1 and replaced("+15551234567").startswith("+1")
    assert replaced("2024-01-31 12 3.5 (12) 34") == "2024-01-31 12 3.5 (12) 34"


def test_whole_names(spark):
    texts = ["Mr John Paul Smith left", "John Paul Smith's dog", "JOHN PAUL SMITH left", "MR SMITH left", "John Q. Public met Dr. Smith", "Prof. Dr. Hans von Braun Jr", "Mr J. R. Smith left", "господин Иван Петрович Сидоров был", "κύριος Νίκος Παπάς και κύριος ΠΑΠΆΣ", "Mr Smith Mrs Smith"]
    got = {r["doc_id"]: r["text"] for r in surrogates.replace_entities(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), b"k").collect()}
    real = {w.casefold() for t in texts for w in re.findall(r"[^\W\d_]{2,}", t)} - set("mr mrs dr prof met left dog von jr господин был κύριος και".casefold().split())
    assert not real & {w.casefold() for t in got.values() for w in re.findall(r"[^\W\d_]{2,}", t)}
    john, paul, smith = re.fullmatch(r"Mr (\w+) (\w+) (\w+) left", got[0]).groups()
    assert got[1] == f"{john} {paul} {smith}'s dog" and got[2] == f"{john} {paul} {smith}".upper() + " left" and got[3] == f"MR {smith.upper()} left"
    assert re.fullmatch(rf"{john} [A-PR-Z]\. \w+ met Dr\. {smith}", got[4]) and re.fullmatch(r"Prof\. Dr\. \w+ von \w+ Jr", got[5])
    assert re.fullmatch(rf"Mr [A-Z]\. [A-Z]\. {smith} left", got[6]) and " J." not in got[6] and " R." not in got[6] and got[9] == f"Mr {smith} Mrs {smith}"


def test_names_of_one_id_are_not_gathered(spark, monkeypatch):
    replace = surrogates._replace

    def watched(key, named):
        run = replace(key, named)

        def counted(batches):
            for b in batches:
                assert not named or max(len(n) for n in b["names"]) <= 2
                yield from run(iter([b]))

        return counted

    monkeypatch.setattr(surrogates, "_replace", watched)
    df = spark.createDataFrame([(None if i % 2 else 7, f"Mr Jonas Nam{chr(97 + i)}") for i in range(20)], "doc_id long, text string")
    got = [r["text"] for r in surrogates.replace_entities(df, b"k").collect()]
    assert len(got) == len(set(got)) == 20 and not any("Nam" in t for t in got)


def test_permutation_is_one_to_one_without_fixed_points():
    p = surrogates.Permutation(b"x" * 64)
    for n in (2, 3, 10, 97, 256):
        image = [p(x, n, "t") for x in range(n)]
        assert sorted(image) == list(range(n)) and all(a != b for a, b in enumerate(image))


def test_name_pool_collisions(spark):
    clash = surrogates.pool_name("m", "latin", 0, 0)
    assert len({surrogates.pool_name(k, "latin", n, r) for k in "mfus" for n in range(300) for r in range(5)}) == 4 * 300 * 5
    parts = [("m", f"name{i}") for i in range(3000)] + [("s", clash.casefold()), ("f", "anna"), ("s", "anna"), ("s", "anna")]
    df = spark.createDataFrame(parts, "kind string, part string")
    t = surrogates.name_table(df, b"key").collect()
    assert len({r["surrogate"].casefold() for r in t}) == len(t) == 3002 and not {r["surrogate"].casefold() for r in t} & {p for _, p in parts}


def test_blocks_round_trip():
    rng = np.random.default_rng(1)
    for ids in ([], [7], [0] * 3000, rng.integers(0, 50_000, 5000), [5] * 1023 + [2**32 - 1] + list(range(1500)), rng.integers(0, 2**32, 1030)):
        x = np.array(ids, np.uint32)
        for block in (64, 1024):
            offsets, data = token_files.pack_blocks(x, block)
            assert (token_files.unpack_blocks(offsets, data, len(x), block) == x).all()
    docs = [rng.integers(0, 40_000, n).astype("<u4") for n in (0, 1, 3000, 5)]
    assert all((a == b).all() for a, b in zip(docs, token_files.unpack_chunk(token_files.pack_chunk([d.tobytes() for d in docs]))))


def test_token_files(odd, odd_rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["start"], r["n_tokens"], r["ids_crc32"]) for r in token_files.token_files(odd, path).collect())
    want, start = [], 0
    for r in sorted(odd_rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids + [1]
        want.append((r[0] if r[0] is not None else -1, start, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids))))
        start += len(ids)
    assert got == sorted(want)
    assert token_files.token_files(empty, path).count() == 0


@pytest.mark.parametrize("bits", [64, 2])
def test_exact_duplicates(odd, odd_rows, empty, bits):
    got = sorted((r["doc_id"] or -1, r["keep_id"] or -1, r["group_size"], r["kept"], r["text_sha256"]) for r in exact_dedup.exact_duplicates(odd, capacity=5, max_depth=6, hash_bits=bits).collect())
    groups = defaultdict(list)
    for r in odd_rows:
        groups[(r[1] or "").translate(LOWER)].append(r[0])
    want = []
    for t, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        want += [(i or -1, keep or -1, len(ids), i == keep, hashlib.sha256(t.encode()).hexdigest()) for i in ids]
    assert got == sorted(want)
    assert exact_dedup.exact_duplicates(empty).count() == 0


def test_directory_doubles(spark):
    e = spark.range(4000).select(exact_dedup.text_hash(F.col("id").cast("string")).alias("hash"))
    d = exact_dedup.directory(e, capacity=300, max_depth=10)
    sizes = e.withColumn("slot", F.shiftrightunsigned("hash", 53)).join(d, "slot").groupBy("bucket", "depth").count().collect()
    assert sum(r["count"] for r in sizes) == 4000 and max(r["count"] for r in sizes) <= 300 and min(r["depth"] for r in sizes) >= 4


def test_drop_exact_keeps_columns(odd):
    out = exact_dedup.drop_exact_duplicates(odd)
    assert out.columns == odd.columns and out.where("doc_id in (3, 80)").count() == 0 and out.where("doc_id = 81").count() == 1


def test_ppm(odd, odd_rows, empty):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6), round(r["score"], 6)) for r in ppm.score_documents(odd, block_bytes=5000).collect())
    order, stream = ppm.ORDER, lambda t: b"\n" * ppm.ORDER + b" ".join(ppm.tokens(t or "")) + b"\n"
    train = [r for r in odd_rows if zlib.crc32(b"" if r[0] is None else str(r[0]).encode()) % 7 != 2]
    level = {order: Counter(s[i - order:i + 1] for s in (stream(r[1]) for r in train) for i in range(order, len(s)))}
    for k in range(order - 1, -1, -1):
        level[k] = Counter(g[1:] for g in level[k + 1])
    ctx = {k: defaultdict(dict) for k in level}
    for k, c in level.items():
        for g, n in c.items():
            ctx[k][g[:-1]][g[-1]] = n

    def p(c, s):
        seen, v = set(), 0.0
        for k in range(order, -1, -1):
            d = ctx[k].get(c[order - k:])
            if d is None:
                continue
            left = {a: n for a, n in d.items() if a not in seen}
            if s in left:
                return v + math.log10((2 * left[s] - 1) / (2 * sum(left.values())))
            if left:
                v += math.log10(len(left) / (2 * sum(left.values())))
            seen |= set(d)
        return v - math.log10(256 - len(seen))

    for c in list(ctx[order])[:2]:
        assert abs(sum(10 ** p(c, s) for s in range(256)) - 1) < 1e-9
    count = Counter(w for r in train for w in ppm.tokens(r[1] or "") + [b"\n"])
    total, kinds, want = sum(count.values()), len(count), []
    for r in odd_rows:
        own, s = ppm.tokens(r[1] or "") + [b"\n"], stream(r[1])
        want.append((r[0] if r[0] is not None else -1, len(own), sum(count[w] > 0 for w in own), total, round(sum(math.log10((count[w] + 1) / (total + kinds + 1)) for w in own), 6), round(sum(p(s[i - order:i], s[i]) for i in range(order, len(s))), 6)))
    near = lambda a, b: a[:4] == b[:4] and abs(a[4] - b[4]) < 1e-4 and abs(a[5] - b[5]) < 1e-4
    assert len(got) == len(want) and all(near(a, b) for a, b in zip(got, sorted(want)))
    assert ppm.score_documents(empty).count() == 0


def test_prefix_bpe_equals_library(odd, odd_rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in bpe.encode_documents(odd, path).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = []
    for r in odd_rows:
        ids = tok.encode(r[1] or "", add_special_tokens=False).ids
        want.append((r[0] if r[0] is not None else -1, len(ids), sha(",".join(map(str, ids))), sha(tok.decode(ids, skip_special_tokens=False))))
    assert got == sorted(want)
    assert bpe.encode_documents(empty, path).count() == 0


def test_prefix_bpe_odd_strings():
    import random

    path, rng = public_tokenizers.path("byte_bpe_50k.json"), random.Random(1)
    tok, enc = Tokenizer.from_file(path), bpe.Encoder(bpe.load_vocabulary(path))
    parts = ["a", "b", " ", "  ", "\n", "\t", "é", "<|endoftext|>", "the", "'s", "123", "٣", "漢", "🙂", " ", "aaaaaaaa", "'LL", "x́", "\x1c", "\x85"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(14))) for _ in range(1500)] + ["a" * 20_000 + "b" * 5000]
    for t, (ids, n, decoded) in zip(texts, enc.texts(texts)):
        want = tok.encode(t, add_special_tokens=False).ids
        assert ids == ",".join(map(str, want)) and n == len(want) and decoded.decode() == tok.decode(want, skip_special_tokens=False)


@pytest.mark.parametrize(("n", "percent", "size"), [(4, 85, 1 << 20), (2, 70, 60)])
def test_jaccard_components(odd, odd_rows, empty, n, percent, size):
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_shingles"], r["component_id"] if r["component_id"] is not None else -1) for r in jaccard_join.near_components(odd, n, percent, task_shingles=size, block_bytes=4000).collect())
    sets = {i: {tuple(w[k:k + n]) for k in range(max(1, len(w) - n + 1))} if (w := words(r[1])) else set() for i, r in enumerate(odd_rows)}
    root = list(range(len(odd_rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = [r[0] for r in odd_rows]
    for a in sets:
        for b in range(a):
            both = len(sets[a] & sets[b])
            same_id = ids[a] is not None and ids[a] == ids[b]
            if same_id or ids[a] is not None and ids[b] is not None and sets[a] and sets[b] and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                root[find(a)] = find(b)
    least = defaultdict(lambda: 10**9)
    for i in sets:
        least[find(i)] = min(least[find(i)], ids[i] if ids[i] is not None else -1)
    want = [(ids[i] if ids[i] is not None else -1, len(sets[i]), least[find(i)] if ids[i] is not None else -1) for i in sets]
    assert got == sorted(want)
    assert jaccard_join.near_components(empty).count() == 0


def test_components_of_a_path(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (3, 3)], "a long, b long")
    got = {r["node"]: r["root"] for r in graph.components(e).collect()}
    assert {got[i] for i in range(100, 161)} == {100} and got[5] == got[7] == got[9] == 5


def test_quality_rules(spark, odd, odd_rows, empty):
    trusted = spark.createDataFrame([(i,) for i in range(40)], "doc_id long")
    got = sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in quality.apply_rules(odd, trusted).collect())
    want = []
    for r in odd_rows:
        t = r[1] or ""
        w = WORD.findall(t)
        grams = [tuple(w[i:i + 5]) for i in range(len(w) - 4)]
        many, marked = Counter(grams), set()
        for i, g in enumerate(grams):
            if many[g] > 1:
                marked.update(range(i, i + 5))
        lines = [x for x in t.split("\n") if WORD.search(x)]
        want.append((r[0] if r[0] is not None else -1, len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(marked), len(w) < 10 or 100 * len(marked) > 20 * len(w)))
    assert got == sorted(want)
    assert quality.apply_rules(empty, trusted).count() == 0


def test_quality_scores(spark):
    rows = [(i, "the cat sat on the mat and the dog ran off to the far hill") for i in range(20)] + [(100 + i, "zz%% qq%% zz## rr%% ss** zz%% tt## uu%% vv%% ww%% xx%%") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = quality.apply_rules(df, df.where("doc_id < 10").select("doc_id"))
    assert {r["doc_id"] < 100: r["kept"] for r in got.collect()} == {True: True, False: False}


def test_mixing(odd, odd_rows, empty):
    got = mixing.mixed_sizes(odd).collect()
    total = Counter()
    for r in odd_rows:
        total[r[3]] += len(WORD.findall(r[1] or ""))
    names = sorted((s for s in total if s is not None)) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, target = set(), {}
    while True:
        rest = sum(total.values()) - sum(3 * total[s] for s in full)
        free = sum(weight[s] for s in names if s not in full)
        target = {s: 3 * total[s] if s in full else rest * weight[s] / free for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * total[s]}
        if not over:
            break
        full |= over
    largest = {s: max(len(WORD.findall(r[1] or "")) for r in odd_rows if r[3] == s) for s in names}
    taken = Counter()
    for r in got:
        taken[r["source"]] += r["taken"]
        assert abs(r["target"] - target[r["source"]]) < 1e-6 and r["taken"] <= 3 * r["size"]
    assert len(got) == len(odd_rows) and all(abs(taken[s] - target[s]) <= largest[s] for s in names)
    assert sorted(map(tuple, mixing.mixed_sizes(odd.repartition(5)).select("doc_id", "taken").fillna(-1).collect())) == sorted(map(tuple, mixing.mixed_sizes(odd).select("doc_id", "taken").fillna(-1).collect()))
    mixed = mixing.mix(odd)
    assert mixed.columns == odd.columns and mixed.count() == sum(r["times"] for r in got)
    assert mixing.mixed_sizes(empty).count() == 0 and mixing.mix(empty).count() == 0


@pytest.mark.parametrize("shared", [7, None])
def test_mixing_cuts_between_rows_of_one_id(spark, shared):
    rows = [(shared, "one two three", "a", i) for i in range(300)] + [(1000 + i, "one two " * (1 + i % 4), "a", i) for i in range(30)] + [(2000 + i, "w " * 9, "b", i) for i in range(300)] + [(9, "w " * (1 + i % 5), "c", i) for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n int").repartition(6)
    got = mixing.mixed_sizes(df).collect()
    taken, target = Counter(), {r["source"]: r["target"] for r in got}
    for r in got:
        taken[r["source"]] += r["taken"]
    mixed = Counter()
    for r in mixing.mix(df).collect():
        mixed[r["source"]] += len(r["text"].split())
    largest = {"a": 8, "b": 9, "c": 5}
    assert len(got) == len(rows) and mixed == taken and all(abs(taken[s] - target[s]) <= largest[s] / 2 for s in largest)


def test_toxicity(spark, odd, empty):
    rows = [(i, f"plain words number {i} are good here" + (" you idiot" if i % 5 == 0 else "")) for i in range(400)]
    df, labels = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 5 == 0)) for i in range(400)] + [(None, 1), (3, None)], "doc_id long, toxic int")
    got = toxicity.toxicity_scores(df, labels).collect()
    assert len(got) == 400 and sum(r["predicted"] == int(r["doc_id"] % 5 == 0) for r in got if r["held_out"]) >= 0.95 * sum(r["held_out"] for r in got)
    scored = toxicity.score(odd, toxicity.fit(df, labels))
    blank = {round(r["toxicity"], 9) for r in scored.where("text is null or trim(text) = ''").collect()}
    assert scored.columns == [*odd.columns, "toxicity"] and scored.count() == odd.count() and len(blank) == 1 and max(blank) < 0.5
    clashing = df.withColumn("toxicity", F.lit("x")).withColumn("row", F.lit(1))
    kept = toxicity.drop_toxic(clashing, labels)
    assert kept.columns == clashing.columns and 300 <= kept.count() <= 340
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def test_sharding(spark, odd, empty):
    shards = [f"s{i}" for i in range(7)]
    table = sharding.lookup_table(shards, 1009)
    assert max(Counter(table).values()) - min(Counter(table).values()) <= 1
    fewer = sharding.lookup_table(shards[:-1], 1009)
    assert sum(a != b for a, b in zip(table, fewer) if a != 6) < 0.25 * 1009
    out = sharding.assign_shards(odd.withColumn("shard", F.lit("x")), "doc_id", shards, 1009)
    rows = out.select("doc_id", "shard_slot", "shard").collect()
    assert len(rows) == odd.count() and all(shards[table[r["shard_slot"]]] == r["shard"] for r in rows)
    assert sharding.assign_shards(empty, "doc_id", shards, 1009).count() == 0
    with pytest.raises(ValueError):
        sharding.lookup_table(shards, 1000)
