"""Collocations: phrases of several words, counted by weighted acyclic automata and scored by their weakest cut.

Texts become shards: runs of word numbers of one language, with the shard's own word list. Only words
that are frequent enough to be in a phrase keep a number, so all others end a window. A shard's windows
(up to the longest phrase, from every word on) are sorted and built into a transducer, state by state: each
window adds only the words that it doesn't share with the one before, and a weight. Transducers are cut by
prefix range, and those of a range are united with their weights summed; a state's sum is its phrase's
count. The few states on a range's border are in two ranges and summed last. Parts of a phrase are looked
up by composing it with the united transducer, a table of states, by joins.

Ranges are balanced by a bounded sample of windows; what is counted does not depend on it.
"""

from __future__ import annotations

import struct
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.llm.common import LOWER, UPPER, block_runs, release, stored, to_blocks

#: Fixed values of the contract: longest phrase, least count, percentage at which a longer phrase replaces
#: a shorter one, phrases reported of a language, and the language of null.
MAX_WORDS, MIN_COUNT, ABSORBED, TOP, NO_LANG = 5, 100, 100, 2000, "und"
#: Words that a shard holds, about, and windows of a prefix range.
SHARD_WORDS, RANGE_WINDOWS = 1 << 20, 1 << 19
#: Most prefix ranges (their bounds travel with the tasks), and windows looked at for the bounds.
MOST_RANGES, SAMPLE = 1 << 17, 200_000
#: Words that a union holds before it merges them.
_MERGE = 1 << 20
#: A byte that UTF-8 text never holds marks the end of a piece.
_BREAK = b"\xff"
_STOPS = b".,;:!?\n\x0b\x0c\r"
_TABLE = bytes.maketrans(UPPER.encode() + _STOPS + b"\t", LOWER.encode() + _BREAK * len(_STOPS) + b" ")
_MOST_WORDS = (1 << 32) - 2


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text, with a mark between pieces."""
    return text.encode("utf-8", "replace").translate(_TABLE).replace(_BREAK, b" \xff ").split()


def _width(words: int) -> str:
    """How a shard of so many distinct words holds its own numbers."""
    return "<u2" if words < 1 << 16 else "<u4"


def _shards(size: int):
    """(lang, vocabulary, counts, total, ids) of runs of about that many words of a language. ids are little-
    endian numbers of words (see _width), from 1 on, and 0 between pieces."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, tuple[dict, list]] = {}
        n = 0

        def flush() -> Iterator[pd.DataFrame]:
            for lang, (number, ids) in held.items():
                ids = np.concatenate(ids)
                count = np.bincount(ids, minlength=len(number))[1:]
                vocabulary = [w.decode() for w in list(number)[1:]]
                yield pd.DataFrame({"lang": [lang], "vocabulary": [vocabulary], "counts": [count], "total": [int(count.sum())], "ids": [ids.astype(_width(len(vocabulary))).tobytes()]})
            held.clear()
            release()

        for b in batches:
            for lang, text in zip(b["lang"], b["t"]):
                if lang not in held:
                    number: dict = defaultdict()
                    number.default_factory = number.__len__
                    number[_BREAK]
                    held[lang] = number, []
                number, ids = held[lang]
                cut = tokens(text)
                ids.append(np.fromiter(map(number.__getitem__, cut), "<u4", len(cut)))
                ids.append(np.zeros(1, "<u4"))
                n += len(cut)
                if n >= size:
                    yield from flush()
                    n = 0
        yield from flush()

    return run


def _renumber(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    """A shard's ids in the numbers of all shards; 0 for words without one. Every word of the shard must have
    its answer."""
    if not len(left):
        raise ValueError("words of a shard that is not there")
    words = int(left["words"].iloc[0])
    if len(right) != words:
        raise ValueError(f"a shard asked for {words} words and got {len(right)}")
    number = np.zeros(words + 1, "<u4")
    number[right["local"].to_numpy()] = right["word_id"].to_numpy()
    return pd.DataFrame({"shard": left["shard"], "ids": [number[np.frombuffer(x, _width(words))].tobytes() for x in left["ids"]]})


def windows(ids: np.ndarray, size: int) -> np.ndarray:
    """The windows (rows) of two to size numbers at every place, cut before a 0 and filled up with 0."""
    out = np.zeros((len(ids), size), np.uint32)
    out[:, 0] = ids
    for k in range(1, min(size, len(ids))):
        out[:len(ids) - k, k] = np.where(out[:len(ids) - k, k - 1] > 0, ids[k:], 0)
    return out[out[:, 1] > 0] if size > 1 else out[:0]


def _keys(rows: np.ndarray) -> list[np.ndarray]:
    """Numbers that sort as the rows do, the first first: two words each."""
    wide = rows.astype(np.uint64)
    return [(wide[:, k] << np.uint64(32)) | (wide[:, k + 1] if k + 1 < rows.shape[1] else np.uint64(0)) for k in range(0, rows.shape[1], 2)]


class Transducer:
    """A weighted acyclic automaton of sorted windows: entry i shares its first same[i] states with the one
    before and adds the rest. rows holds the windows, n their weights."""

    def __init__(self, rows: np.ndarray, n: np.ndarray | None = None):
        """Of windows in any order, with repeats."""
        order = np.lexsort(_keys(rows)[::-1]) if len(rows) else np.zeros(0, np.int64)
        rows = rows[order]
        n = np.ones(len(rows), np.int64) if n is None else n[order]
        if len(rows):
            first = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)]))
            rows, n = rows[first], np.add.reduceat(n, first)
        self.rows, self.n = rows, n

    @staticmethod
    def _shared(rows: np.ndarray) -> np.ndarray:
        equal = np.zeros(rows.shape, bool)
        equal[1:] = rows[1:] == rows[:-1]
        return np.logical_and.accumulate(equal, axis=1).sum(1)

    def cut(self, bounds: np.ndarray) -> Iterator[tuple[int, bytes]]:
        """(range, piece) for each range between bounds (sorted windows; each is the first of its range)."""
        keys, at = _keys(self.rows), [0]
        for bound in zip(*(k.tolist() for k in _keys(bounds))) if len(bounds) else ():
            low, high = at[-1], len(self.rows)
            for own, b in zip(keys, bound):
                low, high = low + int(np.searchsorted(own[low:high], b)), low + int(np.searchsorted(own[low:high], b, "right"))
                if low == high:
                    break
            at.append(low)
        for k, (i, j) in enumerate(zip(at, [*at[1:], len(self.rows)])):
            if j > i:
                yield k, self._pack(i, j)

    def _pack(self, i: int, j: int) -> bytes:
        rows = self.rows[i:j]
        same, length = self._shared(rows).astype(np.uint8), (rows > 0).sum(1).astype(np.uint8)
        depth = np.arange(rows.shape[1])
        new = rows[(depth >= same[:, None]) & (depth < length[:, None])]
        return struct.pack("<IB", j - i, rows.shape[1]) + same.tobytes() + length.tobytes() + self.n[i:j].astype("<u8").tobytes() + new.astype("<u4").tobytes()

    @staticmethod
    def unpack(piece: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(rows, n) of a piece."""
        m, size = struct.unpack_from("<IB", piece)
        same, length = (np.frombuffer(piece, np.uint8, m, 5 + k * m).astype(np.int64) for k in (0, 1))
        n, new = np.frombuffer(piece, "<u8", m, 5 + 2 * m).astype(np.int64), np.frombuffer(piece, "<u4", -1, 5 + 10 * m)
        begin, every = np.cumsum(length - same) - (length - same), np.arange(m)
        rows = np.zeros((m, size), np.uint32)
        for k in range(size):
            adds = same <= k
            own = np.zeros(m, np.uint32)
            has = adds & (length > k)
            own[has] = new[begin[has] + k - same[has]]
            rows[:, k] = own[np.maximum.accumulate(np.where(adds, every, 0))]
        return rows, n

    def states(self, least: int, border: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(prefixes, sums) for each length from two: states of a sum of least or more, and those whose
        prefix is one of a border window, whatever their sum."""
        if not len(self.rows):
            return
        same, length = self._shared(self.rows), (self.rows > 0).sum(1)
        for k in range(2, self.rows.shape[1] + 1):
            start = np.flatnonzero(same < k)
            total = np.add.reduceat(self.n, start)
            prefix = self.rows[start, :k]
            wanted = total >= least
            for b in border:
                wanted |= (prefix == b[:k]).all(1)
            wanted &= length[start] >= k
            if wanted.any():
                yield prefix[wanted], total[wanted]


def _pieces(size: int, bounds: np.ndarray):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids in b["ids"]:
                cut = list(Transducer(windows(np.frombuffer(ids, "<u4"), size)).cut(bounds))
                if cut:
                    yield pd.DataFrame(cut, columns=["block", "piece"])
                del cut
                release()

    return run


def _unite(size: int, least: int, bounds: np.ndarray):
    """(gram, n) of the states of each range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parts: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = 0

        def merged() -> Transducer:
            return Transducer(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]))

        for block, rows in block_runs(batches):
            if rows is not None:
                for piece in rows["piece"]:
                    parts.append(Transducer.unpack(piece))
                    waiting += len(parts[-1][0])
                    if waiting > _MERGE:
                        t = merged()
                        parts, waiting = [(t.rows, t.n)], len(t.rows) // 2
                continue
            border = bounds[max(block - 1, 0):block + 1]
            for prefix, total in merged().states(least, border):
                yield pd.DataFrame({"gram": pd.Series(list(prefix.astype(np.int64)), dtype=object), "n": total})
            parts, waiting = [], 0
            del rows
            release()

    return run


def _some_windows(size: int, each: int):
    """About that many windows of each shard, at even distances."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for ids in b["ids"]:
                own = np.frombuffer(ids, "<u4")
                at = np.unique(np.linspace(0, max(len(own) - size, 0), each).astype(np.int64))
                got = np.concatenate([windows(own[k:k + size], size)[:1] for k in at.tolist()]) if len(own) else np.zeros((0, size))
                yield pd.DataFrame({"w": pd.Series(list(got.astype(np.int64)), dtype=object)})

    return run


def _bounds(shards: DataFrame, n_shards: int, total: int, size: int, range_windows: int) -> np.ndarray:
    """The first windows of all ranges but the first, from a sample of at most about SAMPLE windows."""
    ranges = min(-(-total // range_windows), MOST_RANGES)
    if ranges < 2:
        return np.zeros((0, size), np.uint32)
    every = max(1, -(-n_shards // SAMPLE))
    some = shards.where(F.pmod(F.xxhash64("shard"), F.lit(every)) == 0).select("ids")
    sample = some.mapInPandas(_some_windows(size, max(1, SAMPLE * every // n_shards)), "w array<long>").toPandas()["w"]
    if not len(sample):
        return np.zeros((0, size), np.uint32)
    rows = Transducer(np.array(sample.to_list(), np.uint32)).rows
    return rows[np.unique(np.linspace(0, len(rows), ranges, endpoint=False).astype(np.int64))[1:]]


def _places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows with at: 0 for rare words, else the word's number among the frequent ones of the partition."""
    at = 0
    for b in batches:
        number = at + b["word"].notna().to_numpy().cumsum()
        at = int(number[-1]) if len(number) else at
        yield b.assign(at=np.where(b["often"], number, 0)).drop(columns="often")


def _numbered(listed: DataFrame, min_count: int) -> tuple[DataFrame, DataFrame]:
    """(words, local) of listed (shard, lang, local, word, count): words (lang, word, word_id, n) of min_count or more
    in all, numbered from 1 on without gaps, inside a partition and partition after partition; and local (of, local,
    word_id) with every listed row's answer, 0 for other words. Listed rows are shuffled once, to their word, and
    counted and answered there; a word has one for each shard that holds it."""
    same = Window.partitionBy("lang", "word")
    asked = listed.withColumns({"n": F.sum("count").over(same), "first": F.row_number().over(same.orderBy("shard")) == 1})
    # A frequent word stands, with its count, on the first of its rows only.
    often = F.col("n") >= min_count
    asked = asked.select(F.spark_partition_id().alias("_part"), F.col("shard").alias("of"), "local", often.alias("often"), *[F.when(often & F.col("first"), F.col(c)).alias(c) for c in ("lang", "word", "n")])
    kept = stored(asked.mapInPandas(_places, "_part int, of long, local int, lang string, word string, n long, at long"))
    sizes = sorted((r["_part"], r["n"]) for r in kept.groupBy("_part").agg(F.count("n").alias("n")).collect())  # a row for each task
    first, total = [], 1
    for part, n in sizes:
        first.append((part, total))
        total += n
    if total > _MOST_WORDS:
        raise ValueError("more frequent words than 32-bit numbers")
    # A row for each task: small enough to go with the tasks.
    offsets = F.broadcast(listed.sparkSession.createDataFrame(first, "_part int, _first long"))
    word_id = F.when(F.col("at") > 0, F.col("_first") + F.col("at") - 1).otherwise(0).alias("word_id")
    words = kept.where("word IS NOT NULL").select("_part", "lang", "word", "n", "at").join(offsets, "_part").select("lang", "word", word_id, "n")
    return words, kept.select("_part", "of", "local", "at").join(offsets, "_part").select("of", "local", word_id)


def phrase_counts(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, shard_words: int = SHARD_WORDS, range_windows: int = RANGE_WINDOWS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(words, grams, sizes): words (lang, word, word_id, n) and grams (gram, n), arrays of two to max_words
    word_ids, of at least min_count occurrences, and sizes (lang, total) in words. See mine_phrases."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang")
    texts = docs.select(lang, F.coalesce(F.col("text"), F.lit("")).alias("t"))
    columns = "lang string, vocabulary array<string>, counts array<long>, total long, ids binary"
    shards = stored(texts.mapInPandas(_shards(shard_words), columns).withColumn("shard", F.monotonically_increasing_id()))
    sizes = shards.groupBy("lang").agg(F.sum("total").alias("total"))
    listed = shards.select("shard", "lang", F.posexplode(F.arrays_zip("vocabulary", "counts")).alias("at", "w"))
    listed = listed.select("shard", "lang", (F.col("at") + 1).alias("local"), F.col("w.vocabulary").alias("word"), F.col("w.counts").alias("count"))
    words, local = _numbered(listed, min_count)
    own = shards.select("shard", F.size("vocabulary").alias("words"), "ids")
    numbered = stored(own.groupBy("shard").cogroup(local.groupBy("of")).applyInPandas(_renumber, "shard long, ids binary"))

    row = shards.agg(F.count(F.lit(1)).alias("shards"), F.coalesce(F.sum("total"), F.lit(0)).alias("total")).first()
    bounds = _bounds(numbered, row["shards"], row["total"], max_words, range_windows)
    pieces = numbered.select("ids").mapInPandas(_pieces(max_words, bounds), "block int, piece binary")
    states = to_blocks(pieces, len(bounds) + 1).mapInPandas(_unite(max_words, min_count, bounds), "gram array<long>, n long")
    grams = stored(states.groupBy("gram").agg(F.sum("n").alias("n")).where(F.col("n") >= min_count))
    return words, grams, sizes


def mine_phrases(docs: DataFrame, max_words: int = MAX_WORDS, min_count: int = MIN_COUNT, absorbed: int = ABSORBED, top: int = TOP, **options) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): of each language the top phrases of two to max_words words
    that occur at least min_count times (a) inside pieces of texts.

    score is floor(1000 a n / (l r)) of the cut into two parts, of l and r occurrences, that makes it
    least (the first such cut); n is the language's number of words. Phrases inside a longer one of at least
    absorbed percent of their count are left out. Order: score, a (both descending), phrase (bytes); all are
    exact. A null language is "und"; null, empty and blank texts have no words; very long texts are taken
    whole; repeated rows count each. A language without such phrases has no rows; an empty table gives
    none. Columns but lang and text are not read.
    """
    words, grams, sizes = phrase_counts(docs, max_words, min_count, **options)
    named = grams.select("gram", F.col("n").alias("a"), F.posexplode("gram").alias("at", "word_id")).join(words.select("word_id", "lang", "word"), "word_id")
    named = named.groupBy("gram", "a").agg(F.first("lang").alias("lang"), F.array_sort(F.collect_list(F.struct("at", "word"))).alias("w"))
    size = F.size("gram")
    inner = F.explode(F.array(F.slice("gram", F.lit(1), size - 1), F.slice("gram", F.lit(2), size - 1)))
    # A phrase inside a longer one is inside one that is longer by a word, which is at least as frequent.
    longer = grams.where(size > 2).select(inner.alias("gram"), "n").groupBy("gram").agg(F.max("n").alias("longer"))
    kept = named.join(longer, "gram", "left").where(F.col("longer").isNull() | (100 * F.col("longer") < absorbed * F.col("a")))
    kept = kept.join(sizes, "lang").select("lang", "gram", F.array_join(F.col("w.word"), " ").alias("phrase"), "a", F.col("total").alias("n"))
    parts = grams.unionByName(words.select(F.array("word_id").alias("gram"), "n"))
    cut = kept.select("*", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
    cut = cut.withColumns({"left": F.slice("gram", F.lit(1), F.col("k")), "right": F.slice("gram", F.col("k") + 1, size - F.col("k"))})
    cut = cut.join(parts.select(F.col("gram").alias("left"), F.col("n").alias("l")), "left").join(parts.select(F.col("gram").alias("right"), F.col("n").alias("r")), "right")
    # Products may pass 64 bits: decimals are exact to 38 digits, and Spark raises beyond.
    score = "(1000BD * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) DIV (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    cut = cut.withColumn("score", F.expr(score).cast("long"))
    best = cut.groupBy("lang", "gram", "phrase", "a", "n").agg(F.min(F.struct("score", "k", "l", "r")).alias("m"))
    order = Window.partitionBy("lang").orderBy(F.col("score").desc(), F.col("a").desc(), "phrase")
    ranked = best.select("lang", "phrase", "a", "m.l", "m.r", "n", "m.score").withColumn("rank", F.row_number().over(order).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
