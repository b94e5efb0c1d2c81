"""Token ids in patched frame-of-reference blocks.

Documents are put in ascending order by range partitions; each partition encodes its texts and packs
the ids into chunks of whole documents. A chunk is one binary value with its own index; chunks are
rows of a Parquet table, so that any store Spark reads can hold them.

A chunk: the header (magic, documents, ids, block size), the documents' lengths, the byte offsets of
the blocks, then the blocks. A block: its minimum, the packing width, the number of exceptions, the
values less the minimum packed at that width, then positions and values of those that need more
bits. The width is the one that a percentile of the block's values fit.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rxncurate.llm.common import shared_dir, stored

MAGIC = b"PFR1"
BLOCK = 1024
#: The share of a block's values that the packing width fits.
PERCENTILE = 90
#: A chunk is closed when it has this many ids; a longer document has a chunk of its own.
CHUNK_IDS = 262_144
#: Fixed value of the contract: the id that ends a document.
END_ID = 1
#: How a tokenizer file says that letters and digits form pieces of their own; letters of
#: Latin-1, white space, digits and punctuation without apostrophes; the pieces of texts of these.
LETTERS_APART = r"|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
PLAIN = "".join(map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)])).encode("latin-1") + b" \n\t\r0123456789!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
PART = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]+")
_KNOWN = 500_000
_CHUNKS = "shard int, chunk int, ids_before long, doc_ids array<string>, n_ids long, payload binary"
#: Shards' totals (16 bytes each) are broadcast up to this number.
MOST_BROADCAST_SHARDS = 1_000_000


def pack_blocks(ids: np.ndarray, block: int = BLOCK, percentile: int = PERCENTILE) -> tuple[np.ndarray, bytes]:
    """(offsets of the blocks and the end, the blocks' bytes) of unsigned 32-bit ids."""
    n = len(ids)
    blocks = -(-n // block)
    if not n:
        return np.zeros(1, "<u4"), b""
    grid = np.concatenate([ids, np.repeat(ids[-1:], blocks * block - n)]).reshape(blocks, block).astype(np.uint32)
    low = grid.min(axis=1)
    grid = grid - low[:, None]
    bits = np.frexp(grid.astype(np.float64))[1].astype(np.uint8)  # bits that each value needs
    counts = np.minimum(block, n - np.arange(blocks) * block)
    width = np.sort(bits, axis=1)[:, (block * percentile - 1) // 100]
    over = bits > width[:, None]
    over[-1, counts[-1]:] = False
    payload: list[bytes] = [b""] * blocks
    for w in np.unique(width):
        rows = np.flatnonzero(width == w)
        packed = _pack(grid[rows], int(w))
        for k, r in enumerate(rows):
            at = np.flatnonzero(over[r])
            payload[r] = struct.pack("<IBH", low[r], w, len(at)) + packed[k].tobytes() + at.astype("<u2").tobytes() + grid[r][at].astype("<u4").tobytes()
    offsets = np.concatenate([[0], np.cumsum([len(p) for p in payload])]).astype("<u4")
    return offsets, b"".join(payload)


def _pack(values: np.ndarray, width: int) -> np.ndarray:
    """Low `width` bits of each value, one row of bytes for each block."""
    rows, block = values.shape
    if not width:
        return np.zeros((rows, 0), np.uint8)
    lane = 16 if width <= 16 else 32
    whole = (values & np.uint32((1 << width) - 1)).astype(">u2" if lane == 16 else ">u4")
    bits = np.unpackbits(np.ascontiguousarray(whole).view(np.uint8)).reshape(rows, block, lane)[:, :, lane - width:]
    return np.packbits(np.ascontiguousarray(bits).reshape(rows, block * width), axis=1)


def unpack_blocks(offsets: np.ndarray, data: bytes, n: int, block: int = BLOCK) -> np.ndarray:
    """The ids of all blocks, in order."""
    blocks = len(offsets) - 1
    out = np.zeros((blocks, block), np.uint32)
    heads = [struct.unpack_from("<IBH", data, int(o)) for o in offsets[:-1]]
    width = np.array([h[1] for h in heads], np.int64)
    for w in np.unique(width):
        rows, size = np.flatnonzero(width == w), int(w) * block // 8
        if w:
            raw = np.frombuffer(b"".join([data[int(offsets[r]) + 7:int(offsets[r]) + 7 + size] for r in rows]), np.uint8).reshape(len(rows), size)
            lane = 16 if w <= 16 else 32
            bits = np.zeros((len(rows), block, lane), np.uint8)
            bits[:, :, lane - w:] = np.unpackbits(raw, axis=1).reshape(len(rows), block, w)
            out[rows] = np.packbits(bits.reshape(len(rows), -1), axis=1).view(">u2" if lane == 16 else ">u4")
    for r, (low, w, k) in enumerate(heads):
        if k:
            start = int(offsets[r]) + 7 + w * block // 8
            out[r, np.frombuffer(data, "<u2", k, start)] = np.frombuffer(data, "<u4", k, start + 2 * k)
        out[r] += np.uint32(low)
    return out.reshape(-1)[:n]


def pack_chunk(documents: list[bytes], block: int = BLOCK) -> bytes:
    """One chunk of documents, each given as little-endian unsigned 32-bit ids."""
    lengths = np.array([len(d) // 4 for d in documents], "<u4")
    offsets, data = pack_blocks(np.frombuffer(b"".join(documents), "<u4"), block)
    return MAGIC + struct.pack("<III", len(documents), int(lengths.sum()), block) + lengths.tobytes() + offsets.tobytes() + data


def unpack_chunk(chunk: bytes) -> list[np.ndarray]:
    """The ids of every document of a chunk."""
    if chunk[:4] != MAGIC:
        raise ValueError("not a chunk of token ids")
    docs, n, block = struct.unpack_from("<III", chunk, 4)
    lengths = np.frombuffer(chunk, "<u4", docs, 16)
    at = 16 + 4 * docs
    offsets = np.frombuffer(chunk, "<u4", -(-n // block) + 1, at)
    ids = unpack_blocks(offsets, chunk[at + 4 * len(offsets):], n, block)
    return np.split(ids, np.cumsum(lengths)[:-1]) if docs else []


def plain(text: str) -> bool:
    """Whether a text has only characters of PLAIN and nothing that may be a special token."""
    try:
        return not text.encode("latin-1").translate(None, PLAIN) and "<|" not in text
    except UnicodeEncodeError:
        return False


class WordCache:
    """Encodes texts with the tokenizers library, each distinct piece once; keeps a bounded number.

    A piece is a run of characters between spaces: right for tokenizers whose tokens never hold white
    space. Where the file cuts letters, digits and punctuation apart and marks the ends of words,
    texts of plain characters are cut that way first, and new pieces are encoded in one call, joined
    by spaces.
    """

    def __init__(self, spec: str, most: int = _KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.runs, self.parts, self.most = Tokenizer.from_str(spec), {}, {}, most
        model = json.loads(spec)["model"]
        suffix = model.get("end_of_word_suffix")
        self.ends = None
        if suffix and LETTERS_APART in spec:
            self.ends = np.zeros(max(model["vocab"].values()) + 1, bool)
            self.ends[[i for t, i in model["vocab"].items() if t.endswith(suffix)]] = True
            # Parts are normalised and cut already: the library's model is all they need.
            bare = json.loads(spec) | {"normalizer": None, "added_tokens": [], "pre_tokenizer": {"type": "Sequence", "pretokenizers": [{"type": "WhitespaceSplit"}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}}
            self.bare = Tokenizer.from_str(json.dumps(bare))

    def _learn_parts(self, fresh: list[str]) -> None:
        ids = np.array(self.bare.encode_batch_fast([" ".join(fresh)], add_special_tokens=False)[0].ids, "<u4")
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(fresh):
            raise ValueError("a part of a word has more than one end mark")
        data, at = ids.tobytes(), 0
        for x, stop in zip(fresh, (4 * stops).tolist()):
            self.parts[x] = data[at:stop]
            at = stop

    def _learn_runs(self, fresh: list[str]) -> None:
        for w, e in zip(fresh, self.tokenizer.encode_batch_fast(fresh, add_special_tokens=False)):
            self.runs[w] = np.array(e.ids, "<u4").tobytes()

    def __call__(self, text: str) -> bytes:
        if self.ends is not None and plain(text):
            known, learn, found = self.parts, self._learn_parts, PART.findall(text.lower())
        else:
            known, learn, found = self.runs, self._learn_runs, text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")
        try:
            return b"".join([known[w] for w in found])
        except KeyError:
            if len(known) > self.most:
                known.clear()
            learn([w for w in set(found) if w not in known])
            return b"".join([known[w] for w in found])


def write_token_files(docs: DataFrame, tokenizer: str, path: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Writes the ids of every whole text, each ended by end_id, in ascending order of id (null
    first; rows of equal id by their texts' hashes), as rows (shard, chunk, ids_before, doc_ids, n_ids, payload).

    tokenizer is a file of the tokenizers library whose tokens hold no white space. Shards are
    ranges of ids in order, chunks are in order within a shard, and ids_before counts the ids of a
    shard's chunks before it. Null text counts as empty, and an empty text is the end id alone; a very
    long text has a chunk of its own. Repeated ids are documents like others; an empty table writes
    no chunk. Other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"spec": open(tokenizer, encoding="utf-8").read()})
    end = struct.pack("<I", end_id)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value  # kept by the worker process, and the cache with it
        if "cache" not in own:
            own["cache"] = WordCache(own["spec"])
        shard, chunk, before, ids, packed, size = TaskContext.get().partitionId(), 0, 0, [], [], 0

        def close():
            return pd.DataFrame({"shard": [shard], "chunk": [chunk], "ids_before": [before], "doc_ids": [ids], "n_ids": [size], "payload": [pack_chunk(packed)]})

        for b in batches:
            for i, t in zip(b["id"], b["t"]):
                e = own["cache"](t)
                ids.append(i)
                packed.append(e + end)
                size += len(e) // 4 + 1
                if size >= CHUNK_IDS:
                    yield close()
                    chunk, before, ids, packed, size = chunk + 1, before + size, [], [], 0
        if ids:
            yield close()

    rows = docs.select(F.col(id_col).cast("string").alias("id"), F.col(id_col).alias("_order"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    ordered = rows.repartitionByRange("_order", F.xxhash64("t")).sortWithinPartitions("_order", F.xxhash64("t"), "t")
    ordered.select("id", "t").mapInPandas(run, _CHUNKS).write.parquet(path)


def read_token_files(spark, path: str, id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files alone: start counts the
    ids of all documents before it. Each chunk is decoded where it is read and knows how many ids come
    before it in its shard; only the shards' totals, one row a partition, are summed across shards.
    A file without chunks gives an empty result; null ids come back as null. A very long document is a
    chunk of its own; repeated rows are documents each."""
    chunks = spark.read.parquet(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for before, ids, payload in zip(b["before"], b["doc_ids"], b["payload"]):
                found = unpack_chunk(payload)
                n = np.array([len(x) for x in found], np.int64)
                crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in found]
                yield pd.DataFrame({"id": list(ids), "start": before + np.cumsum(n) - n, "n_tokens": n, "ids_crc32": crc})

    totals = chunks.groupBy("shard").agg(F.sum("n_ids").alias("n"))
    to_shard = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    starts = stored(totals.select("shard", F.coalesce(F.sum("n").over(to_shard), F.lit(0)).alias("shard_start")))
    # One row a shard. Beyond the limit the small side is left to Spark's own choice of join.
    small = F.broadcast(starts) if starts.count() <= MOST_BROADCAST_SHARDS else starts
    before = (F.col("shard_start") + F.col("ids_before")).alias("before")
    placed = chunks.select("shard", "ids_before", "doc_ids", "payload").join(small, "shard").select(before, "doc_ids", "payload")
    decoded = placed.mapInPandas(run, "id string, start long, n_tokens long, ids_crc32 long")
    return decoded.select(F.col("id").cast(id_type).alias("doc_id"), "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, tokenizer: str, end_id: int = END_ID, path: str | None = None) -> DataFrame:
    """Writes the token files of docs to path (else a new shared folder) and reads them back: one row
    for every row of docs, as read_token_files says. Nulls, empty and very long texts and an empty
    table are as write_token_files says."""
    path = path or shared_dir(docs.sparkSession)
    write_token_files(docs, tokenizer, path, end_id)
    return read_token_files(docs.sparkSession, path, docs.schema["doc_id"].dataType.simpleString())
