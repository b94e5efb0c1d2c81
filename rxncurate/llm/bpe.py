"""Byte-level BPE by dynamic programming over prefixes.

For every prefix of a piece exactly one vocabulary token can be the last one of its encoding. The
tokens that end at a position come from a suffix automaton over the vocabulary; a token fits if it
may follow the last token of the prefix before it, which a test on their merge histories decides.
Back-pointers then give the ids. The time is linear in the length, for pieces of any length.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: the public pattern that cuts a text into pieces before the merges.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Most chunks in each of the two generations that an encoder keeps.
_KNOWN = 250_000
_BASE = 17


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in the vocabulary file: printable bytes stand
    for themselves, the others get the letters from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


def load_vocabulary(path: str) -> dict:
    """Tables of a byte-level BPE tokenizer file, as arrays that can be broadcast. Their size is that
    of the vocabulary."""
    spec = json.load(open(path, encoding="utf-8"))
    letters, vocab = byte_letters(), spec["model"]["vocab"]
    size = max(vocab.values()) + 1
    tokens: list[bytes] = [b""] * size
    for t, i in vocab.items():
        tokens[i] = bytes(letters[c] for c in t)
    rank = np.full(size, -1, np.int64)
    left, right = np.zeros(size, np.int64), np.zeros(size, np.int64)
    for r, m in enumerate(spec["model"]["merges"]):
        a, b = m if isinstance(m, list) else m.split(" ")
        i = vocab[a + b]
        if rank[i] < 0:
            rank[i], left[i], right[i] = r, vocab[a], vocab[b]
    added = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"tokens": tokens, "rank": rank, "left": left, "right": right, "added": added} | suffix_automaton(tokens)


def suffix_automaton(tokens: list[bytes]) -> dict:
    """Automaton of all substrings of the tokens: transitions (state << 8 | byte -> state), suffix
    links, longest lengths; and for each state the tokens that are its strings and the next state up
    the links that has some."""
    step: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]

    def split(p: int, c: int, q: int) -> int:
        clone = len(step)
        step.append(dict(step[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        link[q] = clone
        while p >= 0 and step[p].get(c) == q:
            step[p][c] = clone
            p = link[p]
        return clone

    def extend(last: int, c: int) -> int:
        q = step[last].get(c)
        if q is not None:
            return q if longest[q] == longest[last] + 1 else split(last, c, q)
        new, p = len(step), last
        step.append({})
        link.append(0)
        longest.append(longest[last] + 1)
        while p >= 0 and c not in step[p]:
            step[p][c] = new
            p = link[p]
        if p >= 0:
            q = step[p][c]
            link[new] = q if longest[q] == longest[p] + 1 else split(p, c, q)
        return new

    for t in tokens:
        last = 0
        for c in t:
            last = extend(last, c)
    at: dict[int, list[int]] = {}
    for i, t in enumerate(tokens):
        s = 0
        for c in t:
            s = step[s][c]
        if t:
            at.setdefault(s, []).append(i)
    up = [-1] * len(step)
    for s in sorted(range(1, len(step)), key=longest.__getitem__):
        up[s] = link[s] if link[s] in at else up[link[s]]
    keys = np.fromiter((s << 8 | c for s, d in enumerate(step) for c in d), np.int64)
    ends = np.fromiter((q for d in step for q in d.values()), np.int32)
    return {"keys": keys, "ends": ends, "link": np.array(link, np.int32), "longest": np.array(longest, np.int32), "up": np.array(up, np.int32), "at": at}


class Encoder:
    """Encodes pieces and whole texts. Results are kept in two generations: when the younger one is
    full it becomes the older one, whose results are taken over as they are met again. So repeated
    chunks stay known, and rare ones go, in bounded memory."""

    def __init__(self, v: dict, known: int = _KNOWN):
        import regex

        self.cut = regex.compile(PIECES)
        self.added = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(v["added"], key=len, reverse=True)) + ")") if v["added"] else None
        self.ids_of_added = v["added"]
        self.step = dict(zip(v["keys"].tolist(), v["ends"].tolist()))
        self.link, self.longest, up = v["link"].tolist(), v["longest"].tolist(), v["up"].tolist()
        self.tokens = v["tokens"]
        own = {s: sorted(((len(self.tokens[i]), i) for i in ids), reverse=True) for s, ids in v["at"].items()}
        self.own, self.up, self.endings = own, up, {}
        self.go: dict[int, tuple] = {}
        self.rank, self.left, self.right = v["rank"].tolist(), v["left"].tolist(), v["right"].tolist()
        self.merged = {self.left[i] << _BASE | self.right[i]: r for i, r in enumerate(self.rank) if r >= 0}
        self.fits: dict[int, bool] = {}
        self.known, self.older, self.most = {}, {}, known

    def may_follow(self, a: int, b: int) -> bool:
        """Whether b stays apart from a when their bytes stand together. Merges are undone from the
        latest back; before each, no merge across the boundary may have been due earlier (of equal
        ones the left one comes first)."""
        rank, merged, limit = self.rank, self.merged, 1 << 60
        while True:
            r = merged.get(a << _BASE | b)
            if r is not None and r < limit:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, self.right[a]
            else:
                limit, b = rb + 1, self.left[b]

    def move(self, state: int, c: int) -> tuple[int, int, list[tuple[int, int]]]:
        """(next state, matched length if it became shorter and else 0, tokens that end there, longest
        first) of the automaton after one more byte."""
        step, link, at, cut = self.step, self.link, state, 0
        while (q := step.get(at << 8 | c)) is None:
            if not at:
                raise ValueError(f"byte {c} is not in the vocabulary")
            at = link[at]
            cut = self.longest[at] + 1
        ends = self.endings.get(q)
        if ends is None:
            ends, u = [], q if q in self.own else self.up[q]
            while u >= 0:
                ends += self.own.get(u, [])
                u = self.up[u]
            self.endings[q] = ends
        if len(self.go) > 600_000:
            self.go.clear()
        self.go[state << 8 | c] = out = (q, cut, ends)
        return out

    def pieces_of(self, found: list[bytes]) -> Iterator[list[int]]:
        """Ids of pieces. In sorted order, the prefix that a piece shares with the one before it is
        not worked out again."""
        go, fits, tokens, may_follow = self.go, self.fits, self.tokens, self.may_follow
        # For every prefix its last token, ready to be the left part of a pair's key.
        before, last, states, depths = b"", [-1], [0], [0]
        for s in found:
            i = 0
            for a, b in zip(before, s):
                if a != b:
                    break
                i += 1
            before = s
            del last[i + 1:], states[i + 1:], depths[i + 1:]
            state, depth = states[i], depths[i]
            for c in s[i:]:
                i += 1
                state, cut, ends = go.get(state << 8 | c) or self.move(state, c)
                depth = cut or depth + 1
                for n, t in ends:
                    if n > depth:
                        continue
                    if n == i:
                        break
                    key = last[i - n] | t
                    ok = fits.get(key)
                    if ok is None:
                        ok = fits[key] = may_follow(key >> _BASE, t)
                    if ok:
                        break
                last.append(t << _BASE)
                states.append(state)
                depths.append(depth)
            if len(fits) > 500_000:
                fits.clear()
            out = []
            while i:
                t = last[i] >> _BASE
                out.append(t)
                i -= len(tokens[t])
            out.reverse()
            yield out

    def piece(self, s: bytes) -> list[int]:
        """Ids of one piece."""
        return next(self.pieces_of([s]))

    def learn(self, chunks: set[str]) -> None:
        """Adds chunks to those known, new pieces worked out in sorted order: the ids joined by commas,
        once it is seen that they decode to the chunk's own bytes."""
        known, older, tokens = self.known, self.older, self.tokens
        cut: dict[str, list[str]] = {}
        for c in chunks:
            if c in older:
                known[c] = older[c]
            else:
                cut[c] = [c] if c.isalpha() or c[0] == " " and c[1:].isalpha() else self.cut.findall(c)
        pieces = {p for own in cut.values() for p in own}.difference(known)
        again = pieces.intersection(older)
        known.update((p, older[p]) for p in again)
        new = sorted(p.encode() for p in pieces.difference(again))
        for p, ids in zip(new, self.pieces_of(new)):
            if b"".join([tokens[i] for i in ids]) != p:
                raise ValueError("ids do not decode to their piece")
            known[p.decode()] = ",".join(map(str, ids))
        for c, own in cut.items():
            if len(own) > 1:
                known[c] = ",".join([known[p] for p in own])

    def chunks(self, text: str) -> list[str]:
        """The text in parts that begin where pieces do. Single blanks and line ends between words
        always are such places; other white space is left to the pattern."""
        words = text.split()
        blanks = text.count(" ") + text.count("\n")
        if blanks != len(words) - 1 or len(text) - blanks != sum(map(len, words)):
            return self.cut.findall(text)
        if "\n" not in text:
            return words[:1] + [" " + w for w in words[1:]]
        out: list[str] = []
        for k, line in enumerate(text.split("\n")):
            if k:
                out.append("\n")
            first, *rest = line.split(" ")
            out.append(first)
            out += [" " + w for w in rest]
        return out

    def texts(self, texts: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """(ids joined by commas, their number, the bytes they decode to) of whole texts. The strings
        of added tokens stand for their ids. Each chunk's ids were seen to decode to its own bytes when
        it was learnt, and those of an added token stand for its string, so a text's ids decode to
        the chunks and strings they were made for, put together."""
        split, added = self.added.split if self.added else lambda t: [t], self.ids_of_added
        if len(self.known) > self.most:
            self.older, self.known = self.known, {}
        known = self.known
        cut = [[self.chunks(part) if k % 2 == 0 else part for k, part in enumerate(split(t))] for t in texts]
        met = {c for parts in cut for own in parts[::2] for c in own}
        met.discard("")
        self.learn(met.difference(known))
        for parts in cut:
            if len(parts) == 1:
                ids = ",".join([known[c] for c in parts[0] if c])
                decoded = "".join(parts[0])
            else:
                found = [[str(added[own])] if k % 2 else [known[c] for c in own if c] for k, own in enumerate(parts)]
                ids = ",".join([i for own in found for i in own])
                decoded = "".join([own if k % 2 else "".join(own) for k, own in enumerate(parts)])
            yield ids, ids.count(",") + 1 if ids else 0, decoded.encode("utf-8")

    def text(self, text: str) -> tuple[str, int, bytes]:
        return next(self.texts([text]))


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for every row of docs: the encoding of the whole
    text, and the text that its ids decode to. With keep_ids also the array `ids`.

    Null text counts as empty: no tokens, hashes of the empty string. Ids and texts may repeat; each
    row is encoded by itself, without a shuffle. An empty table gives an empty result.
    """
    shared = docs.sparkSession.sparkContext.broadcast({"tables": load_vocabulary(vocabulary)})

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = shared.value  # kept by the worker process, and the encoder with it
        if "encoder" not in own:
            own["encoder"] = Encoder(own["tables"])
        encode = own["encoder"].texts
        for b in batches:
            ids_sha, text_sha, count, every = [], [], [], []
            texts = b["t"].tolist()
            for ids, n, decoded in (x for k in range(0, len(texts), 1000) for x in encode(texts[k:k + 1000])):
                count.append(n)
                ids_sha.append(hashlib.sha256(ids.encode()).hexdigest())
                text_sha.append(hashlib.sha256(decoded).hexdigest())
                if keep_ids:
                    every.append([int(i) for i in ids.split(",")] if n else [])
            out = pd.DataFrame({"doc_id": b["doc_id"], "n_tokens": count, "ids_sha256": ids_sha, "decoded_sha256": text_sha})
            yield out.assign(ids=every) if keep_ids else out

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    return rows.mapInPandas(run, f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * keep_ids)
