"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A bounded sample of labelled rows trains the model in one pass for each epoch, with a learning rate
for each coordinate and L1 regularisation, which leaves few non-zero weights. Those are broadcast;
every document is then scored where it lies, without a shuffle.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rxncurate.llm.common import ascii_lower, id_crc

#: Hashed coordinates; the weights, 12 bytes each that is not zero, are broadcast.
DIMENSIONS = 2**18
#: The model is fitted on at most this many labelled rows, those of lowest hash.
MAX_TRAIN = 20_000
EPOCHS = 2
ALPHA, BETA, L1, L2 = 0.3, 1.0, 4.0, 0.5
#: Letters of a word's stem.
STEM = 7
#: Fixed values of the contract.
HELD_OUT = (4, 2)
THRESHOLD = 0.3

WORD = re.compile(r"[^\W_]+")
_KNOWN_WORDS = 150_000


class Hasher:
    """Coordinates of a text's words, whole and cut to their first STEM letters, of its word pairs
    and of pairs one word apart."""

    def __init__(self, dimensions: int = DIMENSIONS):
        self.dimensions, self.known, self.older = dimensions, {}, {}

    def __call__(self, text: str) -> np.ndarray:
        known, found = self.known, WORD.findall(text)
        if len(known) > _KNOWN_WORDS:  # words that are met again are taken over from the older generation
            self.older, self.known = known, {}
            known = self.known
        older = self.older
        for w in set(found).difference(known):
            known[w] = older[w] if w in older else zlib.crc32(w.encode("utf-8", "surrogatepass")) << 32 | zlib.crc32(w[:STEM].encode("utf-8", "surrogatepass"))
        both = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        h, stem = both >> np.uint64(32), both & np.uint64(0xFFFFFFFF)
        mix = lambda a, k: ((a * np.uint64(0x9E3779B97F4A7C15 + 2 * k)) >> np.uint64(40)) % np.uint64(self.dimensions)
        pair = lambda a, b: a * np.uint64(0xC2B2AE3D27D4EB4F) + b
        return np.concatenate([mix(h, 0), mix(stem, 3), mix(pair(h[:-1], h[1:]), 1), mix(pair(h[:-2], h[2:]), 2)]).astype(np.int64)


def train(batches: Iterator[pd.DataFrame], epochs: int = EPOCHS, dimensions: int = DIMENSIONS) -> pd.DataFrame:
    """(feature, weight) of the weights that are not zero; feature -1 is the intercept."""
    hasher = Hasher(dimensions)
    rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    for b in batches:  # a batch is one array of coordinates, and where each text's end
        own = [np.append(np.unique(hasher(t)), dimensions).astype(np.int32) for t in b["t"]]
        if own:
            rows.append((np.concatenate(own), np.cumsum([len(i) for i in own]), b["y"].to_numpy()))
    hasher.known, hasher.older = {}, {}
    z, n = np.zeros(dimensions + 1), np.zeros(dimensions + 1)
    penalty = np.full(dimensions + 1, L1)
    penalty[dimensions] = 0.0

    def weights(i):
        zi = z[i]
        return np.where(np.abs(zi) <= penalty[i], 0.0, (np.sign(zi) * penalty[i] - zi) / ((BETA + np.sqrt(n[i])) / ALPHA + L2))

    for _ in range(epochs):
        for i, y in ((part.astype(np.intp), y) for flat, ends, ys in rows for part, y in zip(np.split(flat, ends[:-1]), ys)):
            w = weights(i)
            g = 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, w.sum())))) - y
            grown = n[i] + g * g
            z[i] += g - (np.sqrt(grown) - np.sqrt(n[i])) / ALPHA * w
            n[i] = grown
    every = np.arange(dimensions + 1)
    w = weights(every)
    used = np.flatnonzero(w)
    return pd.DataFrame({"feature": np.where(used == dimensions, -1, used), "weight": w[used]})


def fit(docs: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, held_out: tuple[int, int] = HELD_OUT) -> DataFrame:
    """The model (feature int, weight double), learnt from texts of docs whose labels.toxic is 0 or 1
    and whose crc32(doc_id) modulo held_out[0] is not held_out[1]; at most max_train rows, those whose
    ids have the lowest hash. Repeated labels of an id count as toxic if one is; of the rows of one
    id those of lowest text hash come first. Null texts count as empty, rows of null id are not used,
    and without labels the model is the intercept 0. Only this sample is gathered."""
    pick = F.md5(F.col("doc_id").cast("string").cast("binary"))
    ids = (
        labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (id_crc(F.col("doc_id")) % held_out[0] != held_out[1]))
        .groupBy("doc_id").agg(F.max("toxic").cast("double").alias("y")).orderBy(pick, "doc_id").limit(max_train)
        .select(F.col("doc_id").alias("id"), "y", pick.alias("k"))
    )
    labelled = docs.select("doc_id", ascii_lower(F.col("text")).alias("t")).join(F.broadcast(ids), F.col("doc_id") == F.col("id"))
    sample = labelled.select("k", F.xxhash64("t").alias("h"), "t", "y").orderBy("k", "h").limit(max_train)
    sample = sample.coalesce(1).sortWithinPartitions("k", "h")
    return sample.mapInPandas(lambda batches: iter([train(batches)]), "feature int, weight double")


def score(docs: DataFrame, model: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All columns of docs and `toxicity`, the probability of label 1 (a column of this name is
    replaced). The model has at most DIMENSIONS + 1 rows and is broadcast. Null and empty texts get
    the intercept's probability; very long texts are scored whole; repeated rows get equal scores. An empty
    table stays empty."""
    spark = docs.sparkSession
    rows = model.collect()
    dense = np.zeros(DIMENSIONS)
    bias = 0.0
    for r in rows:
        if r["feature"] < 0:
            bias = r["weight"]
        else:
            dense[r["feature"]] = r["weight"]
    used = np.flatnonzero(dense)
    shared = spark.sparkContext.broadcast((used, dense[used], bias))

    @F.pandas_udf("double")
    def probability(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        at, w, b = shared.value
        table, hasher = np.zeros(DIMENSIONS), Hasher()
        table[at] = w

        def one(t: str) -> float:
            i = hasher(t)
            s = table[i]
            hit = i[s != 0.0]
            x = b + (table[np.unique(hit)].sum() if hit.size else 0.0)
            return 1.0 / (1.0 + math.exp(-max(-35.0, min(35.0, x))))

        for p in parts:
            yield pd.Series([one(t) for t in p], dtype="float64")

    return docs.withColumn("toxicity", probability(ascii_lower(F.col(text_col))))


def toxicity_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs. Null and empty texts get the intercept's score;
    a null id counts as the empty text for the split; repeated rows are scored each, alike; very long texts are
    scored whole. Without labels the score is the untrained model's. An empty table gives an empty result;
    other columns are not read."""
    scored = score(docs.select("doc_id", "text"), fit(docs, labels))
    return scored.select("doc_id", (id_crc(F.col("doc_id")) % HELD_OUT[0] == HELD_OUT[1]).alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= threshold).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score is under the threshold, with their columns, whatever their names."""
    wrapped = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("text").alias("text"))
    return score(wrapped, fit(docs, labels)).where(F.col("toxicity") < threshold).select("row.*")
