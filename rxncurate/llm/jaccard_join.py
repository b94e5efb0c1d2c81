"""Exact join of documents by the Jaccard distance of their word n-gram sets.

Jaccard distance is a metric; documents link within a radius. The join goes in these steps:

* A census finds in how many documents each shingle occurs. A document whose shingles occur mostly
  in it alone is farther than the radius from every other, and is left out. (Without it nearly all
  documents would be at distance 1 from every pivot, and no pivot could part them.)
* Pivots are picked among the rest by anchors: each set names two of its shingles by a keyed hash, and
  of all that name one the set with the least share of shingles of its own is the pivot. A set within the radius of a pivot
  is linked to it and belongs to the region of the nearest; a set that no pivot is near is a pivot.
* Pivots are joined with pivots. Two regions can hold a link only if their pivots are at most both
  regions' extents and the radius apart; a prefix of the rarest shingles finds all such pivots.
* Where two such regions are not linked yet, each document that the triangle inequality lets reach
  the other region is measured against its pivot; it is linked, or in the other's window, or out.
* Documents in each other's windows are compared: in one task where they fit, else they are the input
  of the next level, with other anchors and so other pivots. If a level parts too few of them, they
  are cut into slices, of which every pair is compared.

All comparisons are of whole sets, in integers. Shingles are 64-bit hashes of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxncurate.llm.common import LOWER, UPPER, block_runs, deal, stored, to_blocks
from rxncurate.llm.graph import components

#: Bytes of text in a block of the census, about.
BLOCK_BYTES = 16 << 20
#: Most shingles (8 bytes each) of the documents that one task compares.
TASK_SHINGLES = 1 << 20
#: Anchors of a set in each level, and the share of a level's sets that the next may hold at most.
ANCHORS, LEAST_PROGRESS = 2, 0.7
#: Beyond this number of buckets a block's row for a bucket would hold but a few shingles.
_MOST_BUCKETS = 1 << 20
_KNOWN = 200_000
#: Characters of the texts that are shingled at once.
_RUN_CHARS = 1 << 20
_EPSILON = 1e-9
_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Shingler:
    """Sorted distinct 64-bit shingles of texts: of n words, or of all words where there are fewer. Texts
    are worked on a run at a time, so that arrays are long and bounded."""

    def __init__(self, n: int):
        self.n, self.known = n, {}

    def _words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts, one after the other, and how many each has."""
        cut = [t.encode("utf-8", "replace").translate(_TABLE).split() for t in texts]
        every, known = list(chain.from_iterable(cut)), self.known
        if len(known) > _KNOWN:
            known.clear()
        for w in set(every).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        return np.fromiter(map(known.__getitem__, every), np.uint64, len(every)), np.fromiter(map(len, cut), np.int64, len(cut))

    @staticmethod
    def _mixed(h: np.ndarray, size: int) -> np.ndarray:
        """Hash of the window of that many words at every place."""
        out = np.full(len(h) - size + 1, size, np.uint64)
        for k in range(size):
            out = (out * _MULTIPLIER) ^ h[k:len(h) - size + 1 + k]
            out ^= out >> np.uint64(29)
        out *= np.uint64(0xBF58476D1CE4E5B9)
        return out ^ (out >> np.uint64(32))

    def _run(self, texts: list[str]) -> list[np.ndarray]:
        h, lengths = self._words(texts)
        ends = np.cumsum(lengths)
        n = self.n
        whole = self._mixed(h, n) if len(h) >= n else np.zeros(0, np.uint64)
        out = []
        for end, size in zip(ends.tolist(), lengths.tolist()):
            own = whole[end - size:end - n + 1].copy() if size >= n else self._mixed(h[end - size:end], size) if size else h[:0]
            own.sort()
            out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if len(own) > 1 else own)
        return out

    def __call__(self, texts: Iterable[str]) -> list[np.ndarray]:
        out, run, size = [], [], 0
        for t in texts:
            run.append(t)
            size += len(t)
            if size >= _RUN_CHARS:
                out += self._run(run)
                run, size = [], 0
        return out + self._run(run)


def _census(n: int, bits: int):
    """Per block: its distinct shingles by bucket (leading bits; the next 32 bits name the shingle,
    well enough to count it) with the number of its documents that have them."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingles, own = Shingler(n), []
        for block, rows in block_runs(batches):
            if rows is not None:
                own += [x >> np.uint64(32 - bits) for x in shingles(rows["t"])]
                continue
            keys, count = np.unique(np.concatenate(own), return_counts=True)
            own = []
            bucket = (keys >> np.uint64(32)).astype(np.int64)
            cut = np.flatnonzero(np.diff(bucket, prepend=-1))
            ends = np.append(cut[1:], len(keys))
            low, count = keys.astype("<u4"), np.minimum(count, 255).astype(np.uint8)
            yield pd.DataFrame({"block": block, "bucket": bucket[cut], "keys": [low[i:j].tobytes() for i, j in zip(cut, ends)], "counts": [count[i:j].tobytes() for i, j in zip(cut, ends)]})

    return run


def _sum_bucket(b: pd.DataFrame) -> pd.DataFrame:
    """For every block's shingles of a bucket, in the same order, in how many documents they are (255: or more)."""
    keys = np.concatenate([np.frombuffer(x, "<u4") for x in b["keys"]])
    count = np.concatenate([np.frombuffer(x, np.uint8) for x in b["counts"]])
    _, at = np.unique(keys, return_inverse=True)
    total = np.minimum(np.bincount(at, count)[at], 255).astype(np.uint8)
    cut = np.cumsum([len(x) for x in b["counts"]])[:-1]
    return pd.DataFrame({"block": b["block"], "bucket": b["bucket"], "totals": [x.tobytes() for x in np.split(total, cut)]})


def _wide(percent: int) -> int:
    """The similarity, in percent, of pivots whose regions may hold a link: three radii apart."""
    return 3 * percent - 200


def _prefix_size(n: int, percent: int) -> int:
    """How many of n shingles, in any fixed order, must hold one that a set this similar has too."""
    return n * (100 - percent) // 100 + 1


def _profile(n: int, bits: int, percent: int):
    """Per document its set's size and, where enough shingles occur elsewhere, its set, how many are in
    it alone, and the shared ones of its longest prefix, rarest first."""

    def run(docs: pd.DataFrame, sums: pd.DataFrame) -> pd.DataFrame:
        sets = Shingler(n)(docs["t"])
        size = np.fromiter(map(len, sets), np.int64, len(sets))
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        names, at = np.unique(flat >> np.uint64(32 - bits), return_inverse=True)
        totals = np.concatenate([np.frombuffer(x, np.uint8) for x in sums.sort_values("bucket")["totals"]]) if len(sums) else np.zeros(0, np.uint8)
        if len(totals) != len(names):
            raise ValueError("a block was dealt other rows when it was counted: store input that can't be read twice alike")
        df = totals[at]
        shared = np.bincount(np.repeat(np.arange(len(sets)), size), df > 1, len(sets)).astype(np.int64)
        alone, starts = size - shared, np.cumsum(size) - size
        rows: list[tuple] = [(None, None, None)] * len(sets)
        for k in np.flatnonzero((size > 0) & (100 * shared >= percent * size)):
            s, own = sets[k], df[starts[k]:starts[k] + size[k]]
            prefix = np.lexsort((s, own))[alone[k]:_prefix_size(int(size[k]), _wide(percent))]
            rows[k] = (hashlib.blake2b(s.tobytes(), digest_size=16).hexdigest(), s.astype(np.int64), s[prefix].astype(np.int64))
        found = pd.DataFrame(rows, columns=["set_hash", "set", "rarest"])
        return found.assign(n_shingles=size, alone=alone, doc_id=docs["doc_id"].to_numpy())

    return run


def _linked(percent: int) -> Column:
    return 100 * F.col("both") >= percent * F.col("either")


def _distance() -> Column:
    return 1 - F.col("both") / F.col("either")


def _measure(pairs: DataFrame, sets: DataFrame, a: str, b: str) -> DataFrame:
    """pairs with the sizes of the intersection (both) and union (either) of the sets of keys a and b."""
    left = sets.select(F.col("key").alias(a), F.col("set").alias("_a"))
    right = sets.select(F.col("key").alias(b), F.col("set").alias("_b"))
    met = pairs.join(left, a).join(right, b).withColumn("both", F.size(F.array_intersect("_a", "_b")))
    return met.withColumn("either", F.size("_a") + F.size("_b") - F.col("both")).drop("_a", "_b")


def _may_reach(most: Column, sizes: Column, distance: Column) -> Column:
    """Whether sets whose sizes add up to sizes and that share most shingles at most may be that near."""
    return 1 - most / (sizes - most) <= distance


def _pivot_pairs(pivots: DataFrame, percent: int) -> DataFrame:
    """(a, b, extent_a, extent_b): pairs of pivots (key, n, alone, rarest, extent) whose regions may
    hold a link. A pivot alone in its region has no extent (null), and needs less similar ones less.

    Pairs meet at a shingle of both prefixes. At the first that they share, no more can be shared than
    either has from there on, which rules most of the unlike ones out before they become rows."""
    radius = 1 - percent / 100 + _EPSILON

    def prefixes(side: str, some: Column, least: int) -> DataFrame:
        shared = F.greatest((F.floor(F.col("n") * (100 - least) / 100) + 1 - F.col("alone")).cast("int"), F.lit(0))
        rows = pivots.where(some).select("key", "n", "alone", "extent", F.posexplode(F.slice("rarest", F.lit(1), shared)).alias("pos", "shingle"))
        left = F.col("n") - F.col("alone") - F.col("pos")
        return rows.select("shingle", F.col("key").alias(side), F.col("n").alias(f"n_{side}"), left.alias(f"left_{side}"), F.col("extent").alias(f"extent_{side}"))

    alone, large = F.col("extent").isNull(), F.col("extent").isNotNull()
    reach = F.coalesce("extent_a", F.lit(0.0)) + F.coalesce("extent_b", F.lit(0.0)) + radius
    bound = _may_reach(F.least("left_a", "left_b"), F.col("n_a") + F.col("n_b"), reach)
    found = []
    for left, right, least in ((alone, alone, percent), (large, alone, 2 * percent - 100), (large, large, _wide(percent))):
        order = F.col("a") < F.col("b") if left is right else F.col("a") != F.col("b")
        a, b = prefixes("a", left, least), prefixes("b", right, least).withColumnRenamed("shingle", "_shingle")
        met = a.join(b, (F.col("shingle") == F.col("_shingle")) & order & bound)
        found.append(met.select("a", "b", "extent_a", "extent_b").distinct())
    return found[0].unionByName(found[1]).unionByName(found[2])


def _first_link(percent: int):
    """One link (x, y) between the two sides of a region's windows, if there is any: all documents of
    a side are linked with each other through its pivot."""

    def run(g: pd.DataFrame) -> pd.DataFrame:
        none = pd.DataFrame({"x": [], "y": []}, dtype="int64")
        left, right = g[g["side"] == "a"], g[g["side"] == "b"]
        if not len(left) or not len(right):
            return none
        size = np.array([len(s) for s in left["set"]], np.int64)
        names, flat = np.unique(np.concatenate(left["set"].to_list()), return_inverse=True)
        owner, mark = np.repeat(np.arange(len(left)), size), np.zeros(len(names) + 1, bool)
        keys, own, other = left["key"].to_numpy(), left["own"].to_numpy(), left["other"].to_numpy()
        radius = 1 - percent / 100 + _EPSILON
        for y, s, to_b, to_a in zip(right["key"], right["set"], right["own"], right["other"]):
            near = (np.abs(own - to_a) <= radius) & (np.abs(other - to_b) <= radius)
            if not near.any():
                continue
            at = np.searchsorted(names, s)
            at[(at == len(names)) | (names[np.minimum(at, len(names) - 1)] != s)] = len(names)
            mark[at] = True
            mark[-1] = False
            both = np.bincount(owner[mark[flat]], minlength=len(left))
            mark[at] = False
            hit = np.flatnonzero(near & (100 * both >= percent * (size + len(s) - both)))
            if len(hit):
                return pd.DataFrame({"x": [int(keys[hit[0]])], "y": [int(y)]})
        return none

    return run


def _level(items: DataFrame, sets: DataFrame, before: DataFrame | None, level: int, percent: int, task_shingles: int, last: bool) -> tuple[DataFrame, DataFrame | None]:
    """(edges, rest): edges (a, b) that, with those before, connect all linked sets of items (key) but
    those whose both ends are among rest, the sets of regions too large for a task. If last, regions are
    cut into slices instead, and there is no rest."""
    radius = 1 - percent / 100 + _EPSILON
    own = sets if before is None else sets.join(items, "key", "left_semi")
    anchor = lambda k: F.array_min(F.transform("rarest", lambda x: F.xxhash64(x, F.lit(ANCHORS * level + k))))
    lone = (F.col("alone") / F.col("n_shingles")).alias("lone")
    anchors = own.select("key", lone, F.posexplode(F.array(*[anchor(k) for k in range(ANCHORS)])).alias("k", "anchor"))
    first = anchors.groupBy("k", "anchor").agg(F.min(F.struct("lone", "key")).alias("m")).select("k", "anchor", F.col("m.key").alias("pivot"))
    named = stored(anchors.join(first, ["k", "anchor"]).select("key", "pivot").distinct())
    measured = stored(_measure(named.where("key <> pivot"), sets, "key", "pivot"))
    near = measured.where(_linked(percent)).select("key", "pivot", _distance().alias("d"))
    chosen = named.select(F.col("pivot").alias("key")).distinct()
    regions = stored(near.join(chosen, "key", "left_anti").groupBy("key").agg(F.min(F.struct("d", "pivot")).alias("m")).select("key", "m.pivot", "m.d"))
    extents = regions.groupBy(F.col("pivot").alias("key")).agg(F.max("d").alias("extent"))
    pivots = own.join(regions, "key", "left_anti").join(extents, "key", "left").select("key", F.col("n_shingles").alias("n"), "alone", "rarest", "extent")
    reach = F.coalesce("extent_a", F.lit(0.0)) + F.coalesce("extent_b", F.lit(0.0)) + radius
    met = stored(_measure(_pivot_pairs(pivots, percent), sets, "a", "b").withColumn("d", _distance()).where(F.col("d") <= reach))
    edges = near.select(F.col("key").alias("a"), F.col("pivot").alias("b")).unionByName(met.where(_linked(percent)).select("a", "b"))
    edges = stored(edges if before is None else edges.unionByName(before))

    apart = met.where(~_linked(percent) & (F.col("extent_a").isNotNull() | F.col("extent_b").isNotNull()))
    if apart.isEmpty():
        return edges, None
    roots = components(edges)
    of = lambda side: roots.select(F.col("node").alias(side), F.col("root").alias(f"root_{side}"))
    open_pairs = apart.join(of("a"), "a", "left").join(of("b"), "b", "left").where(F.coalesce("root_a", "a") != F.coalesce("root_b", "b"))
    open_pairs = stored(open_pairs.select("a", "b", "d", "extent_a", "extent_b"))
    one = open_pairs.select("a", "b", "d", F.lit("a").alias("side"), F.col("a").alias("pivot"), F.col("b").alias("goal"), F.col("extent_b").alias("extent"))
    two = open_pairs.select("a", "b", "d", F.lit("b").alias("side"), F.col("b").alias("pivot"), F.col("a").alias("goal"), F.col("extent_a").alias("extent"))
    size = lambda c, k: sets.select(F.col("key").alias(c), F.col("n_shingles").alias(f"n_{k}"), (F.col("n_shingles") - F.col("alone")).alias(f"shared_{k}"))
    members = regions.select("key", "pivot", F.col("d").alias("own")).join(size("key", "own"), "key")
    toward = one.unionByName(two).join(size("goal", "goal"), "goal").withColumnRenamed("pivot", "_pivot")
    extent = F.coalesce("extent", F.lit(0.0)) + radius
    near_enough = (F.col("own") >= F.col("d") - extent) & _may_reach(F.least("shared_own", "shared_goal"), F.col("n_own") + F.col("n_goal"), extent)
    may = members.join(toward, (F.col("pivot") == F.col("_pivot")) & near_enough).select("a", "b", "side", "goal", "extent", "key", "own")
    reached = stored(_measure(may, sets, "key", "goal"))
    edges = edges.unionByName(reached.where(_linked(percent)).select(F.col("key").alias("a"), F.col("goal").alias("b")))
    inside = reached.where(~_linked(percent) & (_distance() <= F.col("extent") + radius))
    inside = inside.select("a", "b", "side", "key", "own", _distance().alias("other"), F.lit(0).alias("i"), F.lit(0).alias("j"))
    n_of = sets.select("key", F.col("n_shingles").alias("n"))
    of_side = lambda side: F.coalesce(F.sum(F.when(F.col("side") == side, F.col("n"))), F.lit(0)).alias(f"n_{side}")
    sums = inside.join(n_of, "key").groupBy("a", "b").agg(of_side("a"), of_side("b")).where("n_a > 0 AND n_b > 0")
    sums = stored(sums.withColumn("fits", F.col("n_a") + F.col("n_b") <= task_shingles))
    if sums.isEmpty():
        return edges, None
    fitting = inside.join(sums.where("fits").select("a", "b"), ["a", "b"])
    large = inside.join(sums.where("NOT fits").select("a", "b", "n_a", "n_b"), ["a", "b"])
    if last:
        slices = lambda side: F.ceil(2 * F.col(f"n_{side}") / task_shingles).cast("int")
        mine = lambda side: F.pmod(F.xxhash64("key"), slices(side)).cast("int")
        every = lambda side: F.explode(F.sequence(F.lit(0), slices(side) - 1))
        rows = ["a", "b", "side", "key", "own", "other"]
        a = large.where("side = 'a'").select(*rows, mine("a").alias("i"), every("b").alias("j"))
        b = large.where("side = 'b'").select(*rows, every("a").alias("i"), mine("b").alias("j"))
        fitting = fitting.unionByName(a).unionByName(b)
    with_sets = fitting.join(sets.select("key", "set"), "key")
    links = with_sets.groupBy("a", "b", "i", "j").applyInPandas(_first_link(percent), "x long, y long")
    edges = edges.unionByName(links.select(F.col("x").alias("a"), F.col("y").alias("b")))
    return edges, None if last else large.select("key").distinct()


def link_sets(sets: DataFrame, percent: int, task_shingles: int = TASK_SHINGLES) -> DataFrame:
    """Edges (a, b) between keys that connect the linked ones of sets (key, set, n_shingles, alone,
    rarest), level after level until every region fits a task."""
    edges, items, n, level, last = None, sets.select("key"), sets.count(), 0, False
    while True:
        found, rest = _level(items, sets, edges, level, percent, task_shingles, last)
        if rest is None:
            return found
        edges, items = stored(found), stored(rest)
        left = items.count()
        if not left:
            return edges
        last, n, level = left > LEAST_PROGRESS * n, left, level + 1


def near_components(docs: DataFrame, n: int = 4, percent: int = 85, task_shingles: int = TASK_SHINGLES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_shingles, component_id) for every row of docs: the size of its set of n-word
    shingles and the smallest id that links lead to, its own included. Two documents link when 100
    times the shingles they share is at least percent times those of either. percent is over 66, as
    pivots three radii apart must have something in common.

    Words are cut at white space, lower-cased (A-Z). A shorter text is one shingle; null, empty and
    blank texts have none and link with nothing. Ids are whole numbers; rows that share an id are
    documents of their own, rows of null id link with nothing and have a null component. Equal sets are
    joined once. Very long texts are taken whole. An empty table gives an empty result; other columns
    are not read.
    """
    if percent <= 66:
        raise ValueError("percent must be over 66")
    dealt, blocks = deal(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), block_bytes)
    bits = min(blocks, _MOST_BUCKETS).bit_length()
    dealt = to_blocks(dealt, blocks)
    counted = dealt.mapInPandas(_census(n, bits), "block int, bucket long, keys binary, counts binary")
    sums = to_blocks(counted.groupBy("bucket").applyInPandas(_sum_bucket, "block int, bucket long, totals binary"), blocks)
    columns = "set_hash string, set array<long>, rarest array<long>, n_shingles long, alone int, doc_id long"
    profile = stored(dealt.groupBy("block").cogroup(sums.groupBy("block")).applyInPandas(_profile(n, bits, percent), columns))

    known = profile.where("set_hash IS NOT NULL AND doc_id IS NOT NULL")
    one = [F.first(c).alias(c) for c in ("set", "n_shingles", "alone", "rarest")]
    sets = stored(known.groupBy("set_hash").agg(F.min("doc_id").alias("rep"), *one).withColumn("key", F.monotonically_increasing_id()))
    roots = components(link_sets(sets, percent, task_shingles))
    of_key = roots.join(sets.select(F.col("key").alias("node"), "set_hash", "rep"), "node")
    least = of_key.groupBy("root").agg(F.min("rep").alias("least"))
    of_set = sets.select("set_hash", "rep").join(of_key.join(least, "root").select("set_hash", "least"), "set_hash", "left")
    of_set = of_set.select("set_hash", F.coalesce("least", "rep").alias("component_id"))
    narrow = profile.select("doc_id", "n_shingles", "set_hash")
    alone = narrow.where("set_hash IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    joined = narrow.where("set_hash IS NOT NULL AND doc_id IS NOT NULL").join(of_set, "set_hash").select("doc_id", "n_shingles", "component_id")
    return alone.unionByName(joined)


def drop_near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, **options) -> DataFrame:
    """The rows of docs, with all their columns, whatever their names, less those that are not the
    smallest id of their component. Rows of null id and texts without words stay; rows that share an
    id stay or go together. An empty table stays empty."""
    found = near_components(docs, n, percent, **options)
    gone = found.where(F.col("doc_id") != F.col("component_id")).select(F.col("doc_id").alias("_gone")).distinct()
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")
