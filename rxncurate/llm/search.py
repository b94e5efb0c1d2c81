"""Ranked lexical search: the best documents of each item by a term-weight score, with two trees.

Documents become sparse vectors over the items' terms, in chunks. Inside a chunk documents are ordered
by their weightiest terms and put into a tree whose nodes hold the largest coordinate of each term below;
items stand in a tree of the same kind. A task walks the two trees together: the product of two nodes'
maxima bounds every score below both, and where it is under the weakest kth score of all items below the
one, all their pairs are dropped at once. Nothing else is: results are exact. The walk starts from
kth scores that a few chunks gave, so that most pairs fall early.

The items' own vectors travel with the tasks, in blocks of a bounded number of terms; each block of
items goes over all documents.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.llm.common import LOWER, UPPER, stored

#: Fixed value of the contract: documents of an item.
TOP = 20
#: Terms of items that travel with the tasks at once, about.
BLOCK_TERMS = 1 << 19
#: Documents, and terms in them, that a chunk holds at most (but for one long document).
CHUNK_DOCS, CHUNK_TERMS = 1 << 13, 1 << 20
#: Children of a node: of documents, of items.
DOC_FAN, ITEM_FAN = 16, 4
#: Chunks that give the first kth scores. A bound on the start only: all chunks are searched.
SEED_CHUNKS = 6
#: Nodes that an item looks at before it takes its new kth score into account.
_AT_ONCE = 8
_OTHER = bytes(b for b in range(128) if not chr(b).isalnum())
_TABLE = bytes.maketrans(UPPER.encode() + _OTHER, LOWER.encode() + b" " * len(_OTHER))


def terms(text: str | None) -> list[bytes]:
    """Runs of letters, digits and characters outside ASCII, A-Z lower-cased."""
    return (text or "").encode("utf-8", "replace").translate(_TABLE).split()


def _item_terms(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = [(item, t.decode(), n) for item, text in zip(b["item"], b["text"]) for t, n in Counter(terms(text)).items()]
        yield pd.DataFrame(rows, columns=["item", "term", "repeats"])


class Rows:
    """Sparse rows of whole numbers: row i has values[ends[i - 1]:ends[i]] at the columns of the same place."""

    def __init__(self, ends: np.ndarray, columns: np.ndarray, values: np.ndarray):
        self.ends, self.columns, self.values = ends, columns, values
        self.begins = np.concatenate([[0], ends]).astype(np.int64)[:-1]

    def __len__(self) -> int:
        return len(self.ends)

    def _places(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        size = self.ends[rows] - self.begins[rows]
        return size, np.arange(size.sum()) + np.repeat(self.begins[rows] - (np.cumsum(size) - size), size)

    def take(self, rows: np.ndarray) -> Rows:
        size, at = self._places(rows)
        return Rows(np.cumsum(size), self.columns[at], self.values[at])

    def row(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        return self.columns[self.begins[i]:self.ends[i]], self.values[self.begins[i]:self.ends[i]]

    def maxima(self, fan: int) -> Rows:
        """For every fan rows one that holds the largest value of each column."""
        n = -(-len(self) // fan)
        width = int(self.columns.max()) + 1 if len(self.columns) else 1
        key = np.repeat(np.arange(len(self)) // fan, self.ends - self.begins) * width + self.columns
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.diff(key, prepend=-1))
        node, column = np.divmod(key[first], width)
        values = np.maximum.reduceat(self.values[order], first) if len(first) else self.values[:0]
        return Rows(np.cumsum(np.bincount(node, minlength=n)), column, values)

    def products(self, rows: np.ndarray, dense: np.ndarray, exact_floats: bool) -> np.ndarray:
        """The product of each of the rows with a dense row."""
        size, at = self._places(rows)
        part, owner = self.values[at] * dense[self.columns[at]], np.repeat(np.arange(len(rows)), size)
        if exact_floats:  # sums below 2 ** 53
            return np.bincount(owner, part, len(rows)).astype(np.int64)
        out = np.zeros(len(rows), np.int64)
        np.add.at(out, owner, part)
        return out

    def by_weight(self, weight: np.ndarray) -> np.ndarray:
        """An order that brings rows together whose heaviest two columns are the same."""
        row = np.repeat(np.arange(len(self)), self.ends - self.begins)
        order = np.lexsort((-weight, row))
        column, heaviest = self.columns[order], np.full((2, len(self)), -1, np.int64)
        for k in (0, 1):
            has = self.ends - self.begins > k
            heaviest[k, has] = column[self.begins[has] + k]
        return np.lexsort((heaviest[1], heaviest[0]))


def tree(rows: Rows, fan: int) -> list[Rows]:
    """Levels of maxima, the rows first and the root last."""
    out = [rows]
    while len(out[-1]) > 1:
        out.append(out[-1].maxima(fan))
    return out


class Search:
    """The best documents so far of each item, and the walk that adds a chunk to them."""

    def __init__(self, items: Rows, weight: np.ndarray, top: int, least: np.ndarray):
        """items in terms' repeats; least: scores below which an item's documents are of no use."""
        self.order = items.by_weight(weight[items.columns])
        self.items, self.weight, self.top = tree(items.take(self.order), ITEM_FAN), weight, top
        self.least = np.maximum(least[self.order], 1)
        self.best = [(np.zeros(0, np.int64),) * 3] * len(items)
        bound = self.items[0].values * weight[self.items[0].columns] * 1_000_000
        self.exact_floats = not len(bound) or float(bound.astype(np.float64).sum()) < 2.0 ** 53
        self.dense = np.zeros(len(weight), np.int64)
        self.walked = 0

    def add(self, docs: Rows, doc_ids: np.ndarray, missing: np.ndarray) -> None:
        """docs: coordinates by term, weighted."""
        if not len(docs) or not len(self.items[0]):
            return
        order = docs.by_weight(docs.values)
        self.docs, self.ids, self.missing = tree(docs.take(order), DOC_FAN), doc_ids[order], missing[order]
        self._walk(len(self.items) - 1, 0, len(self.docs) - 1, np.zeros(1, np.int64))

    def _below(self, level: int, nodes: np.ndarray) -> np.ndarray:
        children = (nodes[:, None] * DOC_FAN + np.arange(DOC_FAN)).ravel()
        return children[children < len(self.docs[level])]

    def _bounded(self, item_level: int, item: int, level: int, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nodes that may hold something for the item node, best first, with their bounds."""
        columns, values = self.items[item_level].row(item)
        self.dense[columns] = values
        bound = self.docs[level].products(nodes, self.dense, self.exact_floats)
        self.dense[columns] = 0
        self.walked += len(nodes)
        span = ITEM_FAN ** item_level
        keep = bound >= self.least[item * span:(item + 1) * span].min()
        nodes, bound = nodes[keep], bound[keep]
        order = np.argsort(-bound, kind="stable")
        return nodes[order], bound[order]

    def _walk(self, item_level: int, item: int, level: int, nodes: np.ndarray) -> None:
        nodes, bound = self._bounded(item_level, item, level, nodes)
        if not len(nodes):
            return
        if item_level:
            below = max(level - 1, 0)
            nodes = self._below(below, nodes) if level else nodes
            for child in range(item * ITEM_FAN, min((item + 1) * ITEM_FAN, len(self.items[item_level - 1]))):
                self._walk(item_level - 1, child, below, nodes)
        elif level:
            for k in range(0, len(nodes), _AT_ONCE):
                some = nodes[k:k + _AT_ONCE][bound[k:k + _AT_ONCE] >= self.least[item]]
                if not len(some):
                    break
                self._walk(0, item, level - 1, self._below(level - 1, some))
        else:
            self._take(item, bound, nodes)

    def _take(self, item: int, score: np.ndarray, rows: np.ndarray) -> None:
        old = self.best[item]
        score, ids, missing = np.concatenate([old[0], score]), np.concatenate([old[1], self.ids[rows]]), np.concatenate([old[2], self.missing[rows]])
        order = np.lexsort((ids, missing, -score))[:self.top]
        self.best[item] = score[order], ids[order], missing[order]
        if len(order) == self.top:
            self.least[item] = max(self.least[item], score[order[-1]])

    def found(self) -> pd.DataFrame:
        """(place, doc_id, score): place is the item's among those given."""
        size = [len(b[0]) for b in self.best]
        one = lambda k: np.concatenate([b[k] for b in self.best]) if size else np.zeros(0, np.int64)
        ids = pd.Series(one(1)).astype("Int64").mask(one(2).astype(bool))
        return pd.DataFrame({"place": np.repeat(self.order, size), "doc_id": ids, "score": one(0)})


def _vectors(number: dict[bytes, int]):
    """Chunks of documents: their ids, terms (n), and the items' terms in them with counts."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, lengths, sizes, columns, counts, held = [], [], [], [], [], 0

        def flush() -> pd.DataFrame:
            nonlocal held
            flat = [np.fromiter((x for part in parts for x in part), kind, held) for parts, kind in ((columns, "<u4"), (counts, "<u4"))]
            out = pd.DataFrame({"doc_ids": [list(ids)], "lengths": [list(lengths)], "sizes": [list(sizes)], "columns": [flat[0].tobytes()], "counts": [flat[1].tobytes()]})
            for x in (ids, lengths, sizes, columns, counts):
                x.clear()
            held = 0
            return out

        for b in batches:
            for doc, text in zip(b["doc_id"], b["text"]):
                own = terms(text)
                if not own:
                    continue
                known = Counter(filter(None, map(number.get, own)))
                if ids and (held + len(known) > CHUNK_TERMS or len(ids) >= CHUNK_DOCS):
                    yield flush()
                ids.append(None if pd.isna(doc) else int(doc))
                lengths.append(len(own))
                sizes.append(len(known))
                columns.append([k - 1 for k in known])
                counts.append(list(known.values()))
                held += len(known)
        if ids:
            yield flush()

    return run


def _holders(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(term, n): documents of each batch that hold a term."""
    for b in batches:
        count = np.bincount(np.concatenate([np.frombuffer(x, "<u4") for x in b["columns"]])) if len(b) else np.zeros(0, np.int64)
        has = np.flatnonzero(count)
        yield pd.DataFrame({"term": has, "n": count[has]})


def _search(items: Rows, weight: np.ndarray, docs: int, length: int, top: int, least: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        search = Search(items, weight, top, least)
        for b in batches:
            for doc_ids, lengths, sizes, columns, counts in zip(b["doc_ids"], b["lengths"], b["sizes"], b["columns"], b["counts"]):
                # In Python numbers, as terms of a long corpus times documents may pass 64 bits.
                m = np.array([75 + 25 * int(n) * docs // length for n in lengths], np.int64)
                column, tf = np.frombuffer(columns, "<u4").astype(np.int64), np.frombuffer(counts, "<u4").astype(np.int64)
                sizes = np.asarray(sizes, np.int64)
                value = weight[column] * ((1_000_000_000 * tf) // (1000 * tf + 12 * np.repeat(m, sizes)))
                ids = pd.array(list(doc_ids), "Int64")
                missing = np.asarray(ids.isna())
                search.add(Rows(np.cumsum(sizes), column, value), ids.fillna(0).to_numpy(np.int64), missing)
        yield search.found()

    return run


def _rank_block(docs: DataFrame, wanted: DataFrame, top: int) -> DataFrame:
    """(item, doc_id, score) of at least the top documents of each item of wanted (item, term, repeats)."""
    rows = wanted.toPandas()  # a block of items: bounded
    names = sorted(rows["term"].unique())
    number = {t.encode(): k for k, t in enumerate(names, 1)}
    keys = np.sort(rows["item"].unique())
    place, column = np.searchsorted(keys, rows["item"]), rows["term"].map({t: k for k, t in enumerate(names)}).to_numpy(np.int64)
    order = np.lexsort((column, place))
    items = Rows(np.cumsum(np.bincount(place, minlength=len(keys))), column[order], rows["repeats"].to_numpy(np.int64)[order])

    kind = "doc_ids array<long>, lengths array<long>, sizes array<int>, columns binary, counts binary"
    chunks = stored(docs.mapInPandas(_vectors(number), kind).withColumn("chunk", F.monotonically_increasing_id()))
    total = chunks.agg(F.coalesce(F.sum(F.size("doc_ids")), F.lit(0)).alias("n"), F.coalesce(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)), F.lit(0)).alias("l")).first()
    n, length = int(total["n"]), int(total["l"])
    held = np.zeros(len(names), np.int64)
    for r in chunks.select("columns").mapInPandas(_holders, "term int, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row for each term of the block
        held[r["term"]] = r["n"]
    weight = np.array([math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1))) for df in held.tolist()], np.int64)

    def searched(some: DataFrame, least: np.ndarray) -> DataFrame:
        return some.drop("chunk").mapInPandas(_search(items, weight, n, max(length, 1), top, least), "place int, doc_id long, score long")

    none = np.zeros(len(keys), np.int64)
    first = [r["chunk"] for r in chunks.select("chunk").orderBy(F.xxhash64("chunk"), "chunk").limit(SEED_CHUNKS).collect()]
    in_item = Window.partitionBy("place").orderBy(F.col("score").desc())
    seeds = searched(chunks.where(F.col("chunk").isin(first)), none).withColumn("r", F.row_number().over(in_item)).where(F.col("r") == top)
    least = none.copy()
    for r in seeds.select("place", "score").collect():  # a row for each item of the block
        least[r["place"]] = r["score"]
    key_of = docs.sparkSession.createDataFrame(pd.DataFrame({"place": np.arange(len(keys), dtype=np.int32), "item": keys}), "place int, item long")
    return stored(searched(chunks, least)).join(key_of, "place").select("item", "doc_id", "score")


def rank_documents(docs: DataFrame, items: DataFrame, top: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """(item_id, rank, doc_id, score): for each row of items (item_id, text) its top rows of docs (doc_id, text)
    by score, and by ascending doc_id where scores are equal; null ids come last. Only scores above 0 count.

    Terms are the maximal runs of letters, digits and characters outside ASCII, A-Z lower-cased. With N
    documents that have terms, L terms in all, n in a document and df documents that hold a term, the
    term's weight is floor(1000 ln((2N + 2) / (2df + 1))), m = 75 + 25nN div L, and a term that occurs tf times
    adds its weight times (10^9 tf) div (1000tf + 12m), for each time that the item holds it.

    Null, empty and term-free texts match nothing, in items and documents. Rows that share an id are items,
    or documents, of their own. Very long texts are taken whole. An empty table on either side gives an
    empty result. Other columns are not read.
    """
    listed = stored(items.select("item_id", "text").withColumn("item", F.monotonically_increasing_id()))
    wanted = stored(listed.select("item", "text").mapInPandas(_item_terms, "item long, term string, repeats long"))
    blocks = max(1, -(-wanted.count() // block_terms))
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = [_rank_block(own, wanted.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == k), top) for k in range(blocks)]
    order = Window.partitionBy("item").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last())
    ranked = reduce(DataFrame.unionByName, found).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(listed.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score")
