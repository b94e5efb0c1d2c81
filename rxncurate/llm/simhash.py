"""Near duplicates by SimHash: fingerprints within a Hamming distance, found by walking the binary trie of
all fingerprints against itself.

A node of the trie is a prefix of bits. Two nodes are walked together as long as their prefixes differ
in no more bits than allowed; a pair beyond that budget is dropped with all that is below it. The upper
levels are tables: a round of joins replaces pairs by the pairs of their children, until both sides fit
a task. From there a task walks the rest in arrays and returns a spanning forest of the links it found,
so that a group of many near copies gives few edges. Equal fingerprints are one leaf.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxncurate.llm.common import LOWER, UPPER, stored
from rxncurate.llm.graph import components

BITS = 64
#: Fixed values of the contract: words of a shingle, its hash's seed, bits that linked fingerprints may differ in.
WORDS, SEED, DISTANCE = 4, 42, 4
#: Fingerprints of a node that a task takes: a part of all, within bounds. A pair of nodes is one task.
NODE_SHARE, LEAST_NODE, MOST_NODE = 12, 1 << 12, 1 << 20
#: Levels of the trie that a round of joins goes down.
STEP = 2
#: Node pairs that a task holds at once, and pairs of fingerprints below which it compares all.
_CHUNK, _CELLS = 1 << 16, 64
#: Shingles whose bits are counted at once.
_RUN = 1 << 15
_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())


def fingerprint(text: str | None, n: int = WORDS, seed: int = SEED) -> int:
    """The SimHash of a text, as an unsigned number: a bit is 1 if over half of the hashes of its shingles
    (n words, or all words where there are fewer; repeats count) have it. Without words it is 0."""
    cut = (text or "").encode("utf-8", "replace").translate(_TABLE).split()
    if not cut:
        return 0
    data, digest = b" ".join(cut), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, cut), np.int64, len(cut)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    size = min(n, len(cut))
    first, last = starts[:len(cut) - size + 1].tolist(), ends[size - 1:].tolist()
    total = np.zeros(BITS, np.int64)
    for k in range(0, len(first), _RUN):
        h = np.fromiter((digest(data[i:j], seed) for i, j in zip(first[k:k + _RUN], last[k:k + _RUN])), "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * total > len(first), bitorder="little").view("<u8")[0])


def _fingerprints(n: int, seed: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            prints = np.array([fingerprint(t, n, seed) for t in b["t"]], np.uint64)
            yield pd.DataFrame({"doc_id": b["doc_id"], "fp": prints.view(np.int64)})

    return run


class _Forest:
    """Connected numbers 0 .. n - 1; the smallest of a group is its root."""

    def __init__(self, n: int):
        self.parent, self._u, self._v, self._waiting = np.arange(n), [], [], 0

    def link(self, u: np.ndarray, v: np.ndarray) -> None:
        self._u.append(u)
        self._v.append(v)
        self._waiting += len(u)
        if self._waiting > max(len(self.parent), _CHUNK):
            self.settle()

    def settle(self) -> np.ndarray:
        if self._waiting:
            u, v, p = np.concatenate(self._u), np.concatenate(self._v), self.parent
            self._u, self._v, self._waiting = [], [], 0
            while True:
                ru, rv = p[u], p[v]
                apart = ru != rv
                if not apart.any():
                    break
                u, v, ru, rv = u[apart], v[apart], ru[apart], rv[apart]
                np.minimum.at(p, np.maximum(ru, rv), np.minimum(ru, rv))
                while not np.array_equal(up := p[p], p):
                    p = up
            self.parent = p
        return self.parent


def walk(a: np.ndarray, b: np.ndarray | None, depth: int, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Numbers (x, y) of fingerprints that a link joins, one for each that is not the first of its group: a
    spanning forest of all links between a and b, or inside a if b is None. Both are sorted, distinct and each
    has one prefix of that depth; numbers of b follow those of a."""
    own = b is None
    b = a if own else b
    shift = 0 if own else len(a)
    forest = _Forest(len(a) + (0 if own else len(b)))
    differ = int(np.bitwise_count((a[0] ^ b[0]) >> np.uint64(BITS - depth))) if depth else 0
    if differ > distance:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    one = lambda x: np.array([x], np.int64)
    stack = [(depth, one(0), one(len(a)), one(0), one(len(b)), one(differ))]
    while stack:
        depth, la, ha, lb, hb, d = stack.pop()
        if len(la) > _CHUNK:
            half = len(la) // 2
            stack += [(depth, *(x[half:] for x in (la, ha, lb, hb, d))), (depth, *(x[:half] for x in (la, ha, lb, hb, d)))]
            continue
        cells = (ha - la) * (hb - lb)
        small = cells <= _CELLS if depth < BITS else np.ones(len(la), bool)
        if small.any():
            count, width = cells[small], (hb - lb)[small]
            at = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            width = np.repeat(width, count)
            i, j = np.repeat(la[small], count) + at // width, np.repeat(lb[small], count) + at % width
            hit = np.bitwise_count(a[i] ^ b[j]) <= distance
            if own:
                hit &= i < j
            if hit.any():
                forest.link(i[hit], j[hit] + shift)
            la, ha, lb, hb, d = (x[~small] for x in (la, ha, lb, hb, d))
        if not len(la):
            continue
        bit = np.uint64(BITS - 1 - depth)
        upper = lambda values, low: np.searchsorted(values, ((values[low] >> bit) | np.uint64(1)) << bit)
        ma, mb = upper(a, la), upper(b, lb)
        ma, mb = np.clip(ma, la, ha), np.clip(mb, lb, hb)
        twice = (la == lb) if own else np.zeros(len(la), bool)
        children = ((la, ma, lb, mb, d, True), (ma, ha, mb, hb, d, True), (la, ma, mb, hb, d + 1, True), (ma, ha, lb, mb, d + 1, ~twice))
        kept = [(x0, x1, y0, y1, e, (x1 > x0) & (y1 > y0) & (e <= distance) & some) for x0, x1, y0, y1, e, some in children]
        below = [np.concatenate([c[k][c[5]] for c in kept]) for k in range(5)]
        if len(below[0]):
            stack.append((depth + 1, *below))
    root = forest.settle()
    x = np.flatnonzero(root != np.arange(len(root)))
    return x, root[x]


def _walk_pair(distance: int):
    """(a, b): links between the representatives of the two nodes' fingerprints."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        sides = []
        for side in ("a", "b"):
            rows = g[g["side"] == side]
            fp, rep = rows["fp"].to_numpy().view(np.uint64), rows["rep"].to_numpy()
            order = np.argsort(fp)
            sides.append((fp[order], rep[order]))
        (a, ra), (b, rb) = sides
        x, y = walk(a, b if len(b) else None, int(g["depth"].iloc[0]), distance)
        rep = np.concatenate([ra, rb])
        return pd.DataFrame({"a": rep[x], "b": rep[y]})

    return run


def _prefix(depth: int, c: str = "fp") -> Column:
    return F.shiftrightunsigned(c, BITS - depth)


def _task_pairs(prints: DataFrame, distance: int, most: int) -> list[tuple[int, DataFrame]]:
    """For some depths the pairs (a, b) of nodes, a <= b, that tasks take; every pair of fingerprints within
    the distance is below one of them."""
    spark = prints.sparkSession
    out, depth = [], 0
    pairs = spark.range(1).select(F.lit(0).cast("long").alias("a"), F.lit(0).cast("long").alias("b"))
    while depth + STEP < BITS:
        depth += STEP
        # Every level counts all fingerprints: one aggregation with partial sums, a row for each node.
        nodes = stored(prints.groupBy(_prefix(depth).alias("node")).agg(F.count(F.lit(1)).alias("n")))
        side = lambda c: nodes.select(F.shiftrightunsigned("node", STEP).alias(c), F.col("node").alias(f"_{c}"), F.col("n").alias(f"n_{c}"))
        below = pairs.join(side("a"), "a").join(side("b"), "b").where("_a <= _b")
        below = below.where(F.bit_count(F.col("_a").bitwiseXOR(F.col("_b"))) <= distance)
        below = stored(below.select(F.col("_a").alias("a"), F.col("_b").alias("b"), (F.greatest("n_a", "n_b") <= most).alias("fits")))
        out.append((depth, below.where("fits").select("a", "b")))
        pairs = below.where("NOT fits").select("a", "b")
        if pairs.isEmpty():
            return out
    # Nodes so deep hold at most 2 ** STEP fingerprints.
    return out


def trie_links(prints: DataFrame, distance: int = DISTANCE, node_rows: int | None = None) -> DataFrame:
    """Edges (a, b) between the reps of prints (fp, rep), distinct by fp, that connect all fingerprints
    within the distance. A node of a task holds at most node_rows of them."""
    n = prints.count()
    if node_rows is not None and node_rows < 1 << STEP:
        raise ValueError(f"node_rows must be {1 << STEP} at least")
    most = node_rows or min(max(n // NODE_SHARE, LEAST_NODE), MOST_NODE)
    rows = []
    for depth, pairs in _task_pairs(prints, distance, most):
        own = prints.select(_prefix(depth).alias("node"), "fp", "rep")
        for side, some in (("a", F.lit(True)), ("b", F.col("a") != F.col("b"))):
            met = own.join(pairs.where(some), F.col("node") == F.col(side))
            rows.append(met.select(F.lit(depth).alias("depth"), "a", "b", F.lit(side).alias("side"), "fp", "rep"))
    every = rows[0]
    for r in rows[1:]:
        every = every.unionByName(r)
    return every.withColumnsRenamed({"a": "_a", "b": "_b"}).groupBy("depth", "_a", "_b").applyInPandas(_walk_pair(distance), "a long, b long")


def near_components(docs: DataFrame, n: int = WORDS, distance: int = DISTANCE, seed: int = SEED, node_rows: int | None = None) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs: 16 hex digits and the smallest id that
    links lead to, its own included. Documents link when their fingerprints differ in at most distance bits.

    Words are cut at white space, lower-cased (A-Z). Null, empty and blank texts have fingerprint zero and
    link like any other; a text of fewer than n words is one shingle; very long texts are taken whole, their
    bits counted a run at a time. Ids are whole numbers; rows that share an id are documents of their own,
    with links of their own; rows of null id have a fingerprint, link with nothing and have a null
    component. Repeated rows and ties of a bit (half of the shingles) are no special case: a tie is 0. An
    empty table gives an empty result; other columns are not read.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text"), F.lit("")).alias("t"))
    prints = stored(texts.mapInPandas(_fingerprints(n, seed), "doc_id long, fp long"))
    distinct = stored(prints.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("rep")))
    # An id may stand for several fingerprints, so nodes of the graph are fingerprints until the end.
    numbered = distinct.select("fp", F.col("fp").alias("rep"))
    roots = components(trie_links(numbered, distance, node_rows))
    of_root = roots.join(distinct, F.col("node") == F.col("fp")).groupBy("root").agg(F.min("rep").alias("least"))
    linked = roots.join(of_root, "root").select(F.col("node").alias("fp"), "least")
    component = distinct.join(linked, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id"))
    shown = F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint")
    joined = prints.join(component, "fp", "left")
    return joined.select("doc_id", shown, F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id"))
