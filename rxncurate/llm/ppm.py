"""Language-model scores by prediction by partial matching over bytes.

The trie of byte contexts is a table: one row for each context and next byte, for each order. It is
counted from the training documents; lower orders count the distinct longer contexts (a count grows
only where the longer context was new to the byte). A byte's probability starts at the longest known
context; an unseen byte escapes to the next shorter one, with the bytes seen so far excluded.

Texts stay in blocks. A block asks for its distinct byte n-grams and words once, gets their values
by a join, and sums them for its documents; so nothing of corpus size is broadcast or gathered.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rxncurate.llm.common import LOWER, UPPER, block_runs, deal, id_crc, release, stored, to_blocks

#: Bytes of the longest context. A context and its byte fit 48 bits.
ORDER = 5
#: Bytes of text in a block, about.
BLOCK_BYTES = 24 << 20
#: Fixed values of the contract.
HELD_OUT = (7, 2)
#: Bytes worked on at once inside a block, when counting and when scoring (about 40 bytes of arrays
#: each), and the documents that 16 bits can number.
_COUNT_BYTES, _SCORE_BYTES, _PART_DOCS = 1 << 20, 1 << 19, 65_536
#: Counted runs of a block that are held before they are merged.
_RUNS = 6
_TABLE = bytes.maketrans(UPPER.encode(), LOWER.encode())
_END = b"\n"


def tokens(text: str) -> list[bytes]:
    """Lower-cased (A-Z) words of a text; bytes.split cuts at the contract's white space."""
    return text.encode("utf-8", "replace").translate(_TABLE).split()


def word_key(word: bytes) -> int:
    """A negative 64-bit number; byte n-grams are numbers from 0 on."""
    return -1 - (int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "big") >> 1)


def parts(texts: Iterable[str], size_limit: int) -> Iterator[tuple[int, list[list[bytes]], list[bytes]]]:
    """Runs of documents: the first one's number, their words, and their bytes with end marks. A run is
    of bounded size where documents are; only one is held at a time."""
    first, size, words, run = 0, 0, [], []
    for t in texts:
        words.append(tokens(t))
        run.append(b" ".join(words[-1]) + _END)
        size += len(run[-1])
        if size >= size_limit or len(run) == _PART_DOCS:
            yield first, words, run
            first, size, words, run = first + len(run), 0, [], []
    if run:
        yield first, words, run


def numbered_grams(run: list[bytes]) -> np.ndarray:
    """For every byte of every document, (context and byte) << 16 | document, sorted. Contexts before
    a document's start are filled with end marks."""
    pad = _END * ORDER
    data = np.frombuffer(pad + pad.join(run), np.uint8)
    gram = np.zeros(len(data) - ORDER, np.uint64)
    for j in range(ORDER + 1):
        gram <<= np.uint64(8)
        gram |= data[j:len(data) - ORDER + j]
    lengths = np.array([len(d) for d in run])
    # After the first document, each begins with ORDER bytes of padding that are no symbols.
    starts = np.cumsum(lengths + ORDER) - lengths - ORDER
    symbol = np.ones(len(gram), bool)
    for j in range(ORDER):
        symbol[starts[1:] - ORDER + j] = False
    out = (gram[symbol] << np.uint64(16)) | np.repeat(np.arange(len(run), dtype=np.uint64), lengths)
    out.sort()
    return out


def _counted(ordered: np.ndarray, n: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct numbers of an ordered array and how often each occurs, or the sum of its n."""
    if not len(ordered):
        return ordered, np.zeros(0, np.int64)
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    return ordered[first], np.diff(np.append(first, len(ordered))) if n is None else np.add.reduceat(n, first)


def _merge(runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """One run of (distinct keys, counts) out of several."""
    if len(runs) == 1:
        return runs[0]
    keys, n = (np.concatenate([r[k] for r in runs]) for k in (0, 1))
    order = np.argsort(keys, kind="stable")
    return _counted(keys[order], n[order])


def census(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(block, key, n): the distinct byte n-grams and words of each block, with their counts in
    training documents (0 where only others have them)."""
    runs: list[tuple[np.ndarray, np.ndarray]] = []
    seen: Counter = Counter()
    for block, rows in block_runs(batches):
        if rows is None:
            keys, n = _merge(runs)
            yield pd.DataFrame({"block": block, "key": keys, "n": n})
            yield pd.DataFrame({"block": block, "key": np.fromiter(map(word_key, seen), np.int64, len(seen)), "n": np.fromiter(seen.values(), np.int64, len(seen))})
            runs, seen = [], Counter()
            del keys, n
            release()
            continue
        for held, g in rows.groupby("held"):
            seen[_END] += 0 if held else len(g)
            for _, words, run in parts(g["t"], _COUNT_BYTES):
                for own in words:
                    if held:
                        for w in own:
                            if w not in seen:
                                seen[w] = 0
                    else:
                        seen.update(own)
                keys, n = _counted(numbered_grams(run) >> np.uint64(16))
                runs.append((keys.astype(np.int64), n * (not held)))
                if len(runs) == _RUNS:
                    runs = [_merge(runs)]


def _low(c: Column, order: int) -> Column:
    """The context of that order and the byte, out of a longer one."""
    return c.bitwiseAND((1 << 8 * (order + 1)) - 1)


def trie(grams: DataFrame) -> DataFrame:
    """(level, gram, n) of all orders from the counts (key, n > 0) of the longest."""
    steps = F.array(*[F.struct(F.lit(k).alias("level"), _low(F.col("key"), k).alias("gram"), _low(F.col("key"), k + 1).alias("longer")) for k in range(ORDER)])
    lower = grams.select(F.explode(steps).alias("s")).select("s.*").distinct().groupBy("level", "gram").agg(F.count(F.lit(1)).alias("n"))
    return grams.select(F.lit(ORDER).alias("level"), F.col("key").alias("gram"), "n").unionByName(lower)


def contexts(nodes: DataFrame) -> DataFrame:
    """(level, context, total, kinds, left_total, left_kinds): counts of a context, and what the next
    shorter one has left once the bytes of this context are excluded."""
    below = nodes.select((F.col("level") + 1).alias("level"), F.col("gram").alias("low"), F.col("n").alias("low_n"))
    mask = F.expr("shiftleft(1L, level * 8) - 1")
    own = nodes.withColumn("low", F.col("gram").bitwiseAND(mask)).join(below, ["level", "low"], "left").groupBy("level", F.shiftright("gram", 8).alias("context")).agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum("low_n").alias("shared"))
    shorter = own.select((F.col("level") + 1).alias("level"), F.col("context").alias("low"), F.col("total").alias("low_total"), F.col("kinds").alias("low_kinds"))
    low = F.when(F.col("level") > 1, F.col("context").bitwiseAND(F.expr("shiftleft(1L, (level - 1) * 8) - 1"))).otherwise(F.lit(0).cast("long"))
    return own.withColumn("low", low).join(shorter, ["level", "low"], "left").select(
        "level", "context", "total", "kinds", (F.col("low_total") - F.col("shared")).alias("left_total"), (F.col("low_kinds") - F.col("kinds")).alias("left_kinds"))


def gram_values(asked: DataFrame, nodes: DataFrame, ctx: DataFrame) -> DataFrame:
    """(key, value): log10 probability of each asked byte after its context. Escapes go down one order
    at a time; at each, (2n - 1) / 2T is a seen byte's share and kinds / 2T the escape's."""
    state = asked.select("key", F.lit(0.0).alias("value"), F.lit(False).alias("done"), F.lit(None).cast("long").alias("t"), F.lit(None).cast("long").alias("k"))
    for level in range(ORDER, -1, -1):
        node = nodes.where(F.col("level") == level).select(F.col("gram").alias("g"), "n")
        own = ctx.where(F.col("level") == level).select(F.col("context").alias("c"), "total", "kinds", "left_total", "left_kinds")
        joined = state.join(node, _low(F.col("key"), level) == F.col("g"), "left").join(own, F.shiftright(_low(F.col("key"), level), 8) == F.col("c"), "left")
        total, kinds = F.coalesce("t", "total"), F.coalesce("k", "kinds")
        seen, escape = F.log10((2 * F.col("n") - 1) / (2 * total)), F.log10(kinds / (2 * total))
        hit = ~F.col("done") & F.col("n").isNotNull()
        moved = ~F.col("done") & F.col("n").isNull() & (kinds > 0)
        state = joined.select(
            "key", (F.col("value") + F.when(hit, seen).when(moved, escape).otherwise(F.lit(0.0))).alias("value"), (F.col("done") | hit).alias("done"),
            F.col("left_total").alias("t"), F.col("left_kinds").alias("k"), *([F.col("kinds").alias("bytes")] if not level else []))
    rest = -F.log10(256 - F.coalesce(F.col("bytes"), F.lit(0)))
    return state.select("key", (F.col("value") + F.when(F.col("done"), F.lit(0.0)).otherwise(rest)).alias("value"))


def _places(keys: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """Places of asked in sorted keys; an error if one is not there."""
    at = np.searchsorted(keys, asked)
    if len(asked) and (at.max() >= len(keys) or (keys[at] != asked).any()):
        raise ValueError("a block was dealt other rows when it was counted: store input that can't be read twice alike")
    return at


def _score_block(docs: pd.DataFrame, table: pd.DataFrame) -> pd.DataFrame:
    release()  # of the block before
    order = np.argsort(table["key"].to_numpy(), kind="stable")
    key, value, known = (table.pop(c).to_numpy()[order] for c in ("key", "value", "known"))
    del order
    first = np.searchsorted(key, 0)
    gram, gram_value = key[first:].astype(np.uint64) << np.uint64(16), value[first:]
    n = len(docs)
    gram_keys = key[first:]
    score, base_score, n_known, n_tokens = np.zeros(n), np.zeros(n), np.zeros(n, np.int64), np.zeros(n, np.int64)
    end, at = int(_places(key[:first], np.array([word_key(_END)]))[0]), {}
    for begin, words, run in parts(docs["t"], _SCORE_BYTES):
        new = list(set().union(*words).difference(at))
        at.update(zip(new, _places(key[:first], np.fromiter(map(word_key, new), np.int64, len(new))).tolist()))
        for k, doc in enumerate(words, begin):
            own = np.fromiter(map(at.__getitem__, doc), np.int64, len(doc))
            base_score[k] = value[own].sum() + value[end]
            n_known[k] = np.count_nonzero(known[own]) + int(known[end])
            n_tokens[k] = len(doc) + 1
        numbered = numbered_grams(run)
        _places(gram_keys, _counted(numbered >> np.uint64(16))[0].astype(np.int64))
        bounds = np.append(np.searchsorted(numbered, gram), len(numbered))
        score[begin:begin + len(run)] = np.bincount((numbered & np.uint64(0xFFFF)).astype(np.int64), np.repeat(gram_value, np.diff(bounds)), len(run))
    return pd.DataFrame({"doc_id": docs["doc_id"].to_numpy(), "held_out": docs["held"].to_numpy(), "n_tokens": n_tokens, "n_known": n_known, "base_score": base_score, "score": score})


def score_documents(docs: DataFrame, held_out: tuple[int, int] = HELD_OUT, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for every row of docs.

    The model learns from rows whose crc32(doc_id) modulo held_out[0] is not held_out[1]. score is its
    log10 probability of the words joined by single spaces, and the end mark; base_score is the
    add-one unigram model's. Null and empty texts are an end mark alone; a null id counts as the empty
    text for the split; repeated rows count and score like any. Without training rows bytes are
    uniform. An empty table gives an empty result. Very long texts are worked on whole, one at a time.
    Rows are dealt to blocks by id and text, so that an id or a text of a third of all rows is spread, and both
    readings of docs agree however they are split; a block is one task, and fails if something that it looks
    up was never asked for. Other columns are not read.
    """
    dealt, blocks = deal(docs, block_bytes)
    held = id_crc(F.col("doc_id")) % held_out[0] == held_out[1]
    dealt = to_blocks(dealt.withColumn("held", held), blocks)
    asked = stored(dealt.select("block", "held", "t").mapInPandas(census, "block int, key long, n long"))
    counts = stored(asked.groupBy("key").agg(F.sum("n").alias("n")))
    row = counts.where("key < 0").agg(F.sum("n").alias("tokens"), F.count_if(F.col("n") > 0).alias("kinds")).first()
    train_tokens, kinds = int(row["tokens"] or 0), int(row["kinds"] or 0)
    grams = counts.where("key >= 0")
    nodes = stored(trie(grams.where("n > 0")))
    ctx = stored(contexts(nodes))
    # Grams of the training documents need no escape: their value is the first step's alone.
    top = ctx.where(F.col("level") == ORDER).select("context", "total")
    plain = grams.where("n > 0").join(top, F.shiftright("key", 8) == F.col("context")).select("key", F.log10((2 * F.col("n") - 1) / (2 * F.col("total"))).alias("value"))
    values = plain.unionByName(gram_values(grams.where("n = 0"), nodes, ctx)).select("key", "value", F.lit(True).alias("known"))
    words = counts.where("key < 0").select("key", F.log10((F.col("n") + 1) / F.lit(float(train_tokens + kinds + 1))).alias("value"), (F.col("n") > 0).alias("known"))
    table = to_blocks(asked.select("block", "key").join(values.unionByName(words), "key"), blocks)
    kind = docs.schema["doc_id"].dataType.simpleString()
    scored = dealt.groupBy("block").cogroup(table.groupBy("block")).applyInPandas(_score_block, f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
