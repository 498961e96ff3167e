"""Byte-level BPE encoding and decoding with a two-tier lookup.

A pre-token that is itself in the vocabulary is resolved by a minimal perfect
hash (hash and displace: one digest, one displacement, one compare).  Any other
pre-token is merged by a heap of pair ranks over linked bytes.

The ranks are a file of the caller (about 50,000 rows, bounded by the
vocabulary); the built encoder is broadcast once.  Each worker keeps a bounded
cache of pieces it has encoded.
"""

from __future__ import annotations

import base64
import heapq
from struct import pack

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, cuts_cleanly, pre_tokens


class PerfectHash:
    """Minimal perfect hash of distinct byte strings: ``n`` keys, ``n`` slots.

    Keys are dealt to buckets; the largest bucket first, each gets the smallest
    displacement that moves its keys to free slots; a bucket of one key names a
    free slot outright (negative displacement)."""

    def __init__(self, keys: list[bytes]):
        n = self.n = len(keys)
        self.buckets = max(1, n // 3)
        self.displacement = [0] * self.buckets
        self.slots: list[bytes | None] = [None] * n
        self.values = [-1] * n
        groups: dict[int, list[int]] = {}
        digests = [xxhash.xxh64_intdigest(k) for k in keys]
        for i, h in enumerate(digests):
            groups.setdefault(h % self.buckets, []).append(i)
        order = sorted(groups.items(), key=lambda g: -len(g[1]))
        single = len(order)
        for at, (bucket, members) in enumerate(order):
            if len(members) == 1:
                single = at
                break
            d = 0
            while True:
                d += 1
                places = [self._slot(digests[i], d) for i in members]
                if len(set(places)) == len(places) and all(self.slots[p] is None for p in places):
                    break
                if d > 1_000_000:
                    raise ValueError("keys are not distinct")
            self.displacement[bucket] = d
            for p, i in zip(places, members):
                self.slots[p], self.values[p] = keys[i], i
        free = [p for p in range(n) if self.slots[p] is None]
        for p, (bucket, (i,)) in zip(free, order[single:]):
            self.displacement[bucket] = -p - 1
            self.slots[p], self.values[p] = keys[i], i

    def _slot(self, digest: int, d: int) -> int:
        return ((digest >> 20) ^ (d * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFF)) % self.n

    def find(self, key: bytes) -> int:
        """Position of ``key`` in the list that was hashed, or -1."""
        if not self.n:
            return -1
        h = xxhash.xxh64_intdigest(key)
        d = self.displacement[h % self.buckets]
        p = -d - 1 if d < 0 else self._slot(h, d)
        return self.values[p] if self.slots[p] == key else -1


class Encoder:
    """Encodes and decodes by a table of byte strings and their ranks.  Special
    tokens do not exist: their strings are ordinary text."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.pattern = pattern
        keys = sorted(ranks, key=ranks.__getitem__)
        self.key_ids = [ranks[k] for k in keys]
        self.whole = PerfectHash(keys)
        self.bytes_of = {r: k for k, r in ranks.items()}

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _start(self):
        self._regex = regex.compile(self.pattern).findall
        self._first: dict[str, bytes] = {}
        self._cache: dict[str, bytes] = {}
        self._pre: dict[str, bytes] = {}

    def pre_token(self, piece: bytes) -> list[int]:
        at = self.whole.find(piece)
        return [self.key_ids[at]] if at >= 0 else self.merge(piece)

    def merge(self, piece: bytes) -> list[int]:
        """Lowest rank first, ties to the left, over a linked list of symbols."""
        n, rank_of, shift = len(piece), self.ranks.get, len(piece).bit_length()
        end = list(range(1, n + 1))  # symbol at i is piece[i:end[i]]; the next one starts at end[i]
        before = list(range(-1, n - 1))
        pair = [rank_of(piece[i : i + 2], -1) for i in range(n)]
        pair[-1] = -1
        heap = [(r << shift) + i for i, r in enumerate(pair) if r >= 0]
        heapq.heapify(heap)
        pop, push, low = heapq.heappop, heapq.heappush, (1 << shift) - 1
        while heap:
            r = pop(heap)
            i = r & low
            if pair[i] != r >> shift:
                continue
            right = end[i]
            pair[right] = -1
            e = end[i] = end[right]
            if e < n:
                before[e] = i
                r = pair[i] = rank_of(piece[i : end[e]], -1)
                if r >= 0:
                    push(heap, (r << shift) + i)
            else:
                pair[i] = -1
            p = before[i]
            if p >= 0:
                r = pair[p] = rank_of(piece[p:e], -1)
                if r >= 0:
                    push(heap, (r << shift) + p)
        out, i = [], 0
        while i < n:
            out.append(self.ranks[piece[i : end[i]]])
            i = end[i]
        return out

    def _ids(self, piece: str) -> bytes:
        """Ids (uint32) of a piece of text."""
        got = []
        for p in pre_tokens(self._regex, piece):
            ids = self._pre.get(p)
            if ids is None:
                found = self.pre_token(p.encode("utf-8", "surrogatepass"))
                ids = self._pre[p] = pack(f"<{len(found)}I", *found)
            got.append(ids)
        return b"".join(got)

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if not hasattr(self, "_cache"):
            self._start()
        if len(self._cache) + len(self._pre) + len(self._first) > CACHE_ENTRIES:
            self._start()
        cache = self._cache
        pieces = text.split(" ")
        first = pieces[0]
        head = self._first.get(first)
        if head is None and cuts_cleanly(first):
            head = self._first[first] = self._ids(first)
        try:
            got = list(map(cache.__getitem__, pieces[1:]))
        except KeyError:
            got = []
            for p in pieces[1:]:
                ids = cache.get(p)
                if ids is None:
                    if not cuts_cleanly(p):
                        head = None
                        break
                    ids = cache[p] = self._ids(" " + p)
                got.append(ids)
        if head is None:
            return np.frombuffer(self._ids(text), np.uint32)
        return np.frombuffer(head + b"".join(got), np.uint32)

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


def read_ranks(path: str) -> dict[bytes, int]:
    """A rank file: one base64 token and its rank a line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def encoder(spark: SparkSession, path: str, pattern: str):
    """The encoder of a rank file, broadcast (bounded by the vocabulary)."""
    return spark.sparkContext.broadcast(Encoder(read_ranks(path), pattern))


def _id_lists(found: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, found)], dtype=np.int32)
    flat = np.concatenate([*found, np.empty(0, np.uint32)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))


def encode(text: Column, shared) -> Column:
    """array<int> of token ids; null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def ids_of(texts: pa.Array) -> pa.Array:
        return _id_lists([shared.value.encode(x.as_py()) for x in texts])

    return ids_of(text)


def decode(ids: Column, shared) -> Column:
    """binary: the bytes of the ids; null gives empty bytes."""

    @F.arrow_udf("binary")
    def bytes_of(rows: pa.Array) -> pa.Array:
        return pa.array([shared.value.decode(x.as_py() or ()) for x in rows], pa.binary())

    return bytes_of(ids)


def round_trip(text: Column, shared) -> Column:
    """struct(ids, decoded): ``encode`` and ``decode`` of its ids, without the
    second encoding that two chained functions would cost."""

    @F.arrow_udf("struct<ids: array<int>, decoded: binary>")
    def both(texts: pa.Array) -> pa.Array:
        found = [shared.value.encode(x.as_py()) for x in texts]
        back = pa.array([shared.value.decode(x.tolist()) for x in found], pa.binary())
        return pa.StructArray.from_arrays([_id_lists(found), back], names=["ids", "decoded"])

    return both(text)
