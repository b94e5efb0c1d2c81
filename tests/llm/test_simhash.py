"""SimHash join against all pairs, on small tables with odd rows."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
import xxhash

from rxncurate.llm import simhash

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_fingerprint(t, n=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER))
    shingles = [" ".join(w[i:i + n]) for i in range(len(w) - n + 1)] if len(w) >= n else [" ".join(w)] * bool(w)
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def groups(prints, distance):
    """Smallest number of each one's component, by all pairs."""
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= distance:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def scattered(rng, n, spread):
    out = set()
    while len(out) < n:
        x = rng.getrandbits(64)
        out.add(x)
        for _ in range(rng.randrange(4)):
            for _ in range(rng.randrange(spread)):
                x ^= 1 << rng.randrange(64)
            out.add(x)
    return sorted(out)


@pytest.mark.parametrize("distance", [0, 1, 4, 9])
def test_walk_finds_all_links(distance):
    prints = scattered(random.Random(distance), 900, 6)
    a = np.array(prints, np.uint64)
    x, y = simhash.walk(a, None, 0, distance)
    forest = simhash._Forest(len(a))
    forest.link(x, y)
    assert forest.settle().tolist() == groups(prints, distance)
    assert len(x) == len(prints) - len(set(groups(prints, distance)))
    low, high = a[a < 1 << 63], a[a >= np.uint64(1 << 63)]
    x, y = simhash.walk(low, high, 1, distance)
    whole = simhash._Forest(len(a))
    for p, q, add in (*[(*simhash.walk(s, None, 1, distance), k) for s, k in ((low, 0), (high, len(low)))], (x, y, 0)):
        whole.link(p + add, q + add)
    assert whole.settle().tolist() == groups(prints, distance)


def test_components_against_all_pairs(spark, odd, odd_rows, empty):
    got = sorted(((r["doc_id"], r["fingerprint"], r["component_id"]) for r in simhash.near_components(odd).collect()), key=str)
    prints = [plain_fingerprint(r[1]) for r in odd_rows]
    known = [i for i, r in enumerate(odd_rows) if r[0] is not None]
    root = groups([prints[i] for i in known], 4)
    least = {}
    for i, r in zip(known, root):
        least[r] = min(least.get(r, odd_rows[i][0]), odd_rows[i][0])
    component = {i: least[r] for i, r in zip(known, root)}
    want = sorted(((r[0], f"{p:016x}", component.get(i)) for i, (r, p) in enumerate(zip(odd_rows, prints))), key=str)
    assert got == want and len({c for _, _, c in got}) < len(known)
    assert next(f for i, f, _ in got if i == 84) == "0" * 16
    assert simhash.near_components(empty).count() == 0


@pytest.mark.parametrize("node_rows", [40, None])
def test_trie_in_tables(spark, node_rows):
    rng = random.Random(3)
    centre = rng.getrandbits(64)  # a crowded part of the trie
    prints = sorted({*scattered(rng, 150, 5), *(centre ^ sum(1 << rng.randrange(38, 62) for _ in range(3)) for _ in range(120))})
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    table = spark.createDataFrame([(x, i) for i, x in enumerate(signed)], "fp long, rep long")
    edges = [(r["a"], r["b"]) for r in simhash.trie_links(table, 4, node_rows).collect()]
    assert node_rows or len(edges) < len(prints)
    forest = simhash._Forest(len(prints))
    forest.link(np.array([a for a, _ in edges], np.int64), np.array([b for _, b in edges], np.int64))
    assert forest.settle().tolist() == groups(prints, 4)
    with pytest.raises(ValueError):
        simhash.trie_links(table, 4, 1)
