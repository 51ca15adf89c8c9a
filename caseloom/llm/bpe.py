"""Byte-level BPE by replaying the merges over a corpus of words, and decoding.

The distinct words of a batch form one corpus: their bytes lie one after the other in a linked list of symbols, and
an inverted index leads from the token that a pair merges to, to the positions of such pairs. The merges run in rank
order; each touches its own positions only, and enters the pairs with the new left and right neighbours. Words are
independent of each other, so every task replays its own batches, and no text is shuffled.

Cases: null texts count as empty and give no ids; repeated rows give repeated rows; an empty table gives an empty
table; other columns are ignored, whatever their names. Very long words are merged by the same index, in time
proportional to the merges made.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseloom.llm.segments import SegmentCache


class Ranks:
    """A rank file's vocabulary: each token's bytes by rank, and the rank of a pair's merged token."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.rank = {base64.b64decode(a): int(b) for a, b in pairs}
        self.token = {r: t for t, r in self.rank.items()}
        self.byte = np.array([self.rank[bytes([b])] for b in range(256)], dtype=np.int64)
        self.pairs = np.array([self.rank.get(bytes([a, b]), -1) for a in range(256) for b in range(256)], dtype=np.int64)
        self.known: dict[tuple[int, int], int] = {}

    def merged(self, a: int, b: int) -> int:
        """The rank of the token that a and b merge to, or -1."""
        r = self.known.get((a, b))
        if r is None:
            if len(self.known) > 300_000:
                self.known.clear()
            r = self.known[a, b] = self.rank.get(self.token[a] + self.token[b], -1)
        return r

    def one(self, word: bytes) -> list[int]:
        """A single word, lowest rank first, leftmost among equals, by a heap of pairs."""
        ids: list[int] = [int(self.byte[b]) for b in word]
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i) for i in range(n - 1) if (r := self.merged(ids[i], ids[i + 1])) >= 0]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or self.merged(ids[i], ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b < n and (k := self.merged(ids[a], ids[b])) >= 0:
                    heapq.heappush(heap, (k, a))
        return [x for x in ids if x >= 0]


def replay(words: list[bytes], ranks: Ranks) -> list[bytes]:
    """The ids of each word, as little-endian unsigned 32-bit integers, by all merges over all words in rank order."""
    if not words:
        return []
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(lengths)
    starts = (ends - lengths).tolist()
    raw = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.int64)
    n = len(raw)
    symbol = ranks.byte[raw].tolist()
    after = np.arange(1, n + 1)
    after[ends[lengths > 0] - 1] = -1
    before = np.arange(-1, n - 1)
    before[(ends - lengths)[lengths > 0]] = -1
    index: dict[int, list[int]] = {}
    if n > 1:
        first = ranks.pairs[raw[:-1] * 256 + raw[1:]]
        first[after[:-1] == -1] = -1
        at = np.flatnonzero(first >= 0)
        at = at[np.argsort(first[at], kind="stable")]
        keys, cuts = np.unique(first[at], return_index=True)
        index = dict(zip(keys.tolist(), map(np.ndarray.tolist, np.split(at, cuts[1:]))))
    after, before = after.tolist(), before.tolist()
    merged, known, odd = ranks.merged, ranks.known, set()
    heap = list(index)
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        places = index.pop(r, None)
        if places is None:
            continue
        places.sort()
        for i in places:
            j = after[i]
            a = symbol[i]
            if a < 0 or j < 0:
                continue
            k = known.get((a, symbol[j]))
            if (merged(a, symbol[j]) if k is None else k) != r:
                continue
            symbol[i], symbol[j] = r, -1
            right = after[i] = after[j]
            left = before[i]
            if right >= 0:
                before[right] = i
                k = known.get((r, symbol[right]))
                if k is None:
                    k = merged(r, symbol[right])
                if k >= 0:
                    if k <= r:  # must come before what is left of this merge: rare, done by itself
                        odd.add(i)
                    elif k in index:
                        index[k].append(i)
                    else:
                        index[k] = [i]
                        heapq.heappush(heap, k)
            if left >= 0:
                k = known.get((symbol[left], r))
                if k is None:
                    k = merged(symbol[left], r)
                if k >= 0:
                    if k <= r:
                        odd.add(i)
                    elif k in index:
                        index[k].append(left)
                    else:
                        index[k] = [left]
                        heapq.heappush(heap, k)
    left = np.array(symbol, dtype=np.int64)
    stays = left >= 0
    ids = left[stays].astype("<u4").tobytes()
    cuts = np.concatenate(([0], np.cumsum(stays)))[np.concatenate(([0], ends))] * 4
    cuts = cuts.tolist()
    out = [ids[a:b] for a, b in zip(cuts, cuts[1:])]
    for w in {bisect_right(starts, i) - 1 for i in odd}:
        out[w] = np.array(ranks.one(words[w]), dtype="<u4").tobytes()
    return out


class Encoder:
    """Texts to ids as little-endian unsigned 32-bit integers, with a cache of segments; and back."""

    def __init__(self, path: str, pattern: str, block: int = 40_000, cached: int = 200_000):
        self.ranks, self.pattern, self.block, self.cached = Ranks(path), regex.compile(pattern), block, cached
        self.cache = SegmentCache(self._segments, cached // 4)
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = [self.ranks.token.get(i, b"") for i in range(max(self.ranks.token, default=-1) + 1)]
        self.sizes = np.array([len(t) for t in vocabulary], dtype=np.int32)
        self.starts = (np.cumsum(self.sizes) - self.sizes).astype(np.int32)
        self.letters = np.frombuffer(b"".join(vocabulary), dtype=np.uint8)

    def _segments(self, texts: list[str]) -> list[bytes]:
        cut = list(map(self.pattern.findall, texts))
        words = set().union(*cut) if cut else set()
        young, old = self.young, self.old
        words.difference_update(young)
        again = words.intersection(old)
        for w in again:
            young[w] = old[w]
        words = list(words.difference(again))
        for at in range(0, len(words), self.block):
            some = words[at:at + self.block]
            young.update(zip(some, replay([w.encode("utf-8", "replace") for w in some], self.ranks)))
        out = [young[c[0]] if len(c) == 1 else b"".join([young[w] for w in c]) for c in cut]
        if len(young) > self.cached:
            self.old, self.young = young, {}
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        return self.cache.texts(texts)

    def decode(self, ids: bytes) -> bytes:
        at = np.frombuffer(ids, dtype="<u4")
        sizes = self.sizes[at]
        ends = np.cumsum(sizes)
        if not len(at):
            return b""
        where = np.repeat(self.starts[at] - ends + sizes, sizes)
        where += np.arange(ends[-1], dtype=where.dtype)
        return self.letters[where].tobytes()


_encoders: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """One per Python worker, as reading the vocabulary takes time."""
    if (path, pattern) not in _encoders:
        _encoders[path, pattern] = Encoder(path, pattern)
    return _encoders[path, pattern]


def encode(docs: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", rows: int = 1000, decoded: bool = False) -> DataFrame:
    """id_col, ids (binary, little-endian unsigned 32-bit), and with decoded the bytes that the ids stand for, made
    from the ids in the same worker. rows: texts that are encoded together."""
    picked = docs.select(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))

    names = [id_col, "ids", "decoded"][:2 + decoded]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(path, pattern)
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                b = whole.slice(at, rows)
                ids = e.encode(b.column(1).to_pylist())
                back = [pa.array([e.decode(x) for x in ids], pa.binary())] if decoded else []
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.binary()), *back], names=names)

    kind = picked.schema[0].dataType.simpleString()
    return picked.mapInArrow(run, f"`{id_col}` {kind}, ids binary" + ", decoded binary" * decoded)


def decode(ids: Column | str, path: str, pattern: str) -> Column:
    """The bytes that binary ids stand for, as a column; null stays null."""

    @F.pandas_udf("binary")
    def back(col: pd.Series) -> pd.Series:
        e = encoder(path, pattern)
        return col.map(lambda x: None if x is None else e.decode(bytes(x)))

    return back(ids)
