"""Ranked search and phrases against plain Python, on small tables with odd rows."""

from __future__ import annotations

import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest

from rxncurate.llm import phrases, search

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
ITEMS = [(1, "tana rester MOKO"), (2, None), (3, ""), (4, "--- !"), (5, "one"), (5, "two two two one"), (None, "naïve 漢字"), (7, "zzz nowhere")]


def plain_ranks(docs, items, top):
    own = [(i, Counter(TERM.findall((t or "").translate(LOWER)))) for i, t in docs]
    n_docs, length = sum(1 for _, c in own if c), sum(sum(c.values()) for _, c in own)
    df = Counter(t for _, c in own for t in c)
    out = []
    for item, text in items:
        found = []
        for doc, c in own:
            m = 75 + 25 * sum(c.values()) * n_docs // max(length, 1)
            score = 0
            for t, q in Counter(TERM.findall((text or "").translate(LOWER))).items():
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += q * w * (10 ** 9 * c[t] // (1000 * c[t] + 12 * m))
            if score:
                found.append((-score, doc is None, doc or 0, doc))
        found.sort()
        out += [(item, k, doc, -s) for k, (s, _, _, doc) in enumerate(found[:top], 1)]
    return sorted(out, key=str)


@pytest.mark.parametrize("settings", [{}, {"block_terms": 3, "top": 3}])
def test_ranks(spark, odd, odd_rows, empty, monkeypatch, settings):
    items = ITEMS + [(100 + r[0], r[1]) for r in odd_rows[60:66]]
    table = spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, doc_id string")
    if settings:
        monkeypatch.setattr(search, "CHUNK_DOCS", 5)
        monkeypatch.setattr(search, "SEED_CHUNKS", 2)
    got = sorted((tuple(r) for r in search.rank_documents(odd, table, **settings).collect()), key=str)
    assert got == plain_ranks([(r[0], r[1]) for r in odd_rows], items, settings.get("top", 20))
    if not settings:
        assert search.rank_documents(empty, table).count() == 0
        assert search.rank_documents(odd, table.limit(0)).count() == 0


def test_two_trees_prune_and_stay_exact():
    rng = np.random.default_rng(4)
    terms, docs, items, top = 400, 3000, 60, 5
    weight = np.sort(rng.integers(1, 9000, terms))

    def some(n, most):
        rows = [np.unique(np.minimum(rng.geometric(0.02, rng.integers(0, most)), terms) - 1) for _ in range(n)]
        return search.Rows(np.cumsum([len(r) for r in rows]), np.concatenate(rows), rng.integers(1, 4, sum(len(r) for r in rows)))

    d, q = some(docs, 12), some(items, 6)
    d.values = d.values * weight[d.columns] * 1000
    ids = rng.permutation(docs)
    dense = np.zeros((docs, terms), np.int64)
    dense[np.repeat(np.arange(docs), d.ends - d.begins), d.columns] = d.values
    for exact in (True, False):
        s = search.Search(q, weight, top, np.zeros(items, np.int64))
        s.exact_floats = exact
        for a, b in ((0, 1000), (1000, 3000)):
            s.add(d.take(np.arange(a, b)), ids[a:b], np.zeros(b - a, bool))
        got = s.found()
        for i in range(items):
            own = np.zeros(terms, np.int64)
            own[q.row(i)[0]] = q.row(i)[1]
            score = dense @ own
            best = [(int(ids[k]), int(score[k])) for k in np.lexsort((ids, -score))[:top] if score[k] > 0]
            rows = got[got["place"] == i]
            assert list(zip(rows["doc_id"], rows["score"])) == best
        assert s.walked < 0.9 * docs * items


def plain_phrases(docs, max_words, least, absorbed, top):
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in range(1, max_words + 1):
                counts[lang].update(tuple(w[i:i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, f in counts.items():
        candidates = {g for g, a in f.items() if len(g) > 1 and a >= least}
        inside = {h[i:i + k] for h in candidates for k in range(2, len(h)) for i in range(len(h) - k + 1) if 100 * f[h] >= absorbed * f[h[i:i + k]]}
        rows = []
        for g in candidates - inside:
            cuts = [(1000 * f[g] * total[lang] // (f[g[:k]] * f[g[k:]]), k) for k in range(1, len(g))]
            score, k = min(cuts)
            rows.append((-score, -f[g], " ".join(g).encode(), f[g[:k]], f[g[k:]]))
        rows.sort()
        out += [(lang, rank, p.decode(), -a, left, right, total[lang], -s) for rank, (s, a, p, left, right) in enumerate(rows[:top], 1)]
    return sorted(out)


@pytest.fixture(scope="module")
def chatter():
    rng = random.Random(8)
    common, rare = [f"w{k}" for k in range(6)] + ["Ünï", "the"], [f"r{k}" for k in range(300)]
    line = lambda n: " ".join(rng.choice(common if rng.random() < 0.8 else rare) + rng.choice(["", "", "", ",", ". ", "\n"]) for _ in range(n))
    rows = [(i, line(rng.randrange(1, 60)), rng.choice(["en", "de", None])) for i in range(120)]
    rows += [(200 + i, "Copied passage of the same five Words; again", "en") for i in range(30)]
    return rows + [(300, None, "en"), (301, "", None), (302, " .,\t\n", "fr"), (303, line(5000), "de"), (None, rows[3][1], "en"), (3, rows[3][1], "en"), (304, "a b " * 40, "xx"), (305, "\x00 \x1c \x00 \x1c \x00 \x1c   x", "en")]


@pytest.mark.parametrize("settings", [
    {"max_words": 5, "min_count": 6, "absorbed": 100, "top": 2000}, {"max_words": 3, "min_count": 4, "absorbed": 80, "top": 15, "shard_words": 600, "range_windows": 300},
    {"max_words": 5, "min_count": 5, "absorbed": 100, "top": 40, "shard_words": 300, "range_windows": 200}])
def test_phrases(spark, chatter, empty, settings):
    docs = spark.createDataFrame([(*r, "x") for r in chatter], "doc_id long, text string, lang string, gram string").repartition(3)
    got = sorted(tuple(r) for r in phrases.mine_phrases(docs, **settings).collect())
    want = plain_phrases([(r[2], r[1]) for r in chatter], *(settings[k] for k in ("max_words", "min_count", "absorbed", "top")))
    assert got == want and len(got) > 15
    if settings["max_words"] == 3:
        assert phrases.mine_phrases(empty).count() == 0
        assert phrases.mine_phrases(docs, min_count=10 ** 6).count() == 0


def test_transducers():
    rng = np.random.default_rng(2)
    ids = rng.integers(0, 5, 3000).astype(np.uint32)
    whole = phrases.Transducer(phrases.windows(ids, 5))
    rows, n = phrases.Transducer.unpack(whole._pack(0, len(whole.rows)))
    assert (rows == whole.rows).all() and (n == whole.n).all() and n.sum() == (ids[1:] * ids[:-1] > 0).sum()
    bounds = whole.rows[[3, 50, 51, 700 % len(whole.rows)]]
    bounds = bounds[np.lexsort(bounds.T[::-1])]
    cut = dict(whole.cut(bounds))
    back = [phrases.Transducer.unpack(cut[k]) for k in sorted(cut)]
    assert (np.concatenate([r for r, _ in back]) == whole.rows).all() and len(cut) == 5
    halves = [phrases.Transducer(phrases.windows(x, 5)) for x in (ids[:1000], ids[1000:])]
    united = phrases.Transducer(np.concatenate([h.rows for h in halves]), np.concatenate([h.n for h in halves]))
    assert united.n.sum() == sum(h.n.sum() for h in halves)
    states = {tuple(p): s for prefix, total in united.states(1, bounds[:0]) for p, s in zip(prefix.tolist(), total.tolist())}
    plain = Counter(tuple(x[i:i + k]) for x in (ids[:1000].tolist(), ids[1000:].tolist()) for k in range(2, 6) for i in range(len(x) - k + 1) if all(x[i:i + k]))
    assert states == plain
    assert [len(phrases.windows(ids[:k], 5)) for k in (0, 1)] == [0, 0] and phrases.windows(np.array([4, 7], np.uint32), 5).tolist() == [[4, 7, 0, 0, 0]]


def test_words_are_numbered_in_one_shuffle(spark):
    """Counting and answering took two shuffles of all shards' word lists, one of them only beyond a broadcast's size."""
    listed = spark.createDataFrame([(s, "en", k + 1, f"w{k}", k) for s in range(3) for k in range(40)], "shard long, lang string, local int, word string, count long")
    words, local = phrases._numbered(listed.repartition(5), 60)
    numbers = {r["word"]: (r["word_id"], r["n"]) for r in words.collect()}
    assert {w: n for w, (_, n) in numbers.items()} == {f"w{k}": 3 * k for k in range(20, 40)}
    assert sorted(i for i, _ in numbers.values()) == list(range(1, 21))
    assert sorted((r["of"], r["local"], r["word_id"]) for r in local.collect()) == [(s, k + 1, numbers[f"w{k}"][0] if k >= 20 else 0) for s in range(3) for k in range(40)]
    assert "hashpartitioning" not in local._jdf.queryExecution().executedPlan().toString()


def test_short_word_lists_hold_short_numbers():
    docs = pd.DataFrame({"lang": ["en", "en"], "t": ["a b, a", " ".join(f"w{k}" for k in range(70_000))]})
    narrow, wide = [next(phrases._shards(1)(iter([docs.iloc[[k]]]))).iloc[0] for k in (0, 1)]
    assert np.frombuffer(narrow["ids"], "<u2").tolist() == [1, 2, 0, 1, 0]
    assert np.frombuffer(wide["ids"], "<u4").tolist() == [*range(1, 70_001), 0]
