"""Token counts by rank-synchronous array merging.

The pre-tokens of a batch lie end to end in one numpy array.  Each round looks
up the ranks of all neighbouring pairs at once, takes every sequence's lowest
one, and merges all its occurrences, in all sequences, simultaneously.  When no
pair merges any more the surviving symbols of each sequence are its tokens.

Merging all occurrences of the lowest pair at once gives the same symbols as
one merge at a time as long as every merge ranks after the merges that made
its parts; ``Merges`` checks that of the vocabulary.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, cuts_cleanly, pre_tokens

#: The split of the byte-level pre-tokenizer.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Symbols merged together in one array.
BATCH_SYMBOLS = 1 << 20


def byte_letters() -> dict[int, str]:
    """The printable character that stands for each byte in byte-level files:
    itself where printable, else the next free one from 256 on."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(keep)]
    return {b: chr(b) for b in keep} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Merges:
    """Merge table of a byte-level BPE file, as sorted arrays."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        born = np.full(max(vocab.values()) + 1, -1, np.int64)
        born[made[::-1]] = np.arange(len(pairs))[::-1]
        at = np.arange(len(pairs))
        if len(pairs) and not ((born[left] < at).all() and (born[right] < at).all() and len(np.unique(made)) == len(made)):
            raise ValueError("merges are not in the order that made their parts")
        self.base = len(born)
        key = left * self.base + right
        order = np.argsort(key)
        self.keys, self.rank, self.made = key[order], at[order], made[order]
        letters = byte_letters()
        self.byte_ids = np.array([vocab[letters[b]] for b in range(256)], np.int64)

    def symbols(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, lengths): the surviving symbols of all pieces end to end and
        how many of them each piece has."""
        flat = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.byte_ids[flat]
        owner = np.repeat(np.arange(len(pieces)), [len(p) for p in pieces])
        done_ids, done_owner = [], []
        none = len(self.keys)
        while len(ids) > 1 and none:
            key = ids[:-1] * self.base + ids[1:]
            at = np.minimum(np.searchsorted(self.keys, key), none - 1)
            hit = (self.keys[at] == key) & (owner[:-1] == owner[1:])
            if not hit.any():
                break
            rank = np.where(hit, self.rank[at], none)
            start = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            low = np.minimum.reduceat(np.r_[rank, none], start)
            size = np.diff(np.r_[start, len(ids)])
            merge = hit & (rank == np.repeat(low, size)[:-1])
            # in a run of overlapping occurrences (a a a) every second one merges
            run = np.flatnonzero(merge)
            if len(run) > 1:
                fresh = np.r_[True, run[1:] != run[:-1] + 1]
                first = np.maximum.accumulate(np.where(fresh, run, 0))
                run = run[(run - first) % 2 == 0]
            ids[run] = self.made[at[run]]
            keep = np.ones(len(ids), bool)
            keep[run + 1] = False
            live = np.repeat(low < none, size)  # finished sequences leave the array
            if not live.all():
                out = keep & ~live
                done_ids.append(ids[out])
                done_owner.append(owner[out])
                keep &= live
            ids, owner = ids[keep], owner[keep]
        ids = np.concatenate([*done_ids, ids])
        owner = np.concatenate([*done_owner, owner])
        order = np.argsort(owner, kind="stable")
        return ids[order], np.bincount(owner, minlength=len(pieces))

    def counts(self, pieces: list[bytes]) -> np.ndarray:
        """Number of tokens of each piece."""
        out, at = np.zeros(len(pieces), np.int64), 0
        while at < len(pieces):
            end, size = at, 0
            while end < len(pieces) and (end == at or size + len(pieces[end]) <= BATCH_SYMBOLS):
                size += len(pieces[end])
                end += 1
            out[at:end] = self.symbols(pieces[at:end])[1]
            at = end
        return out


class Counter:
    """Counts tokens of texts as the file's own library would, with strings of
    special tokens inside a text taken as those tokens (its default)."""

    def __init__(self, spec: dict):
        pre = spec["pre_tokenizer"]
        if spec["normalizer"] or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or not pre["use_regex"]:
            raise ValueError("a byte-level file without normalizer or prefix space is expected")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.merges = Merges(spec["model"])

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def _start(self):
        self._split = regex.compile(PATTERN).findall
        longest = sorted(self.special, key=len, reverse=True)
        self._special = regex.compile("|".join(map(regex.escape, longest))) if longest else None
        self._later: dict[str, int] = {}
        self._first: dict[str, int] = {}

    def _pre_tokens(self, piece: str) -> list[bytes]:
        return [p.encode("utf-8", "surrogatepass") for p in pre_tokens(self._split, piece)]

    def _parts(self, text: str) -> list[str]:
        """The text between special tokens."""
        if self._special and self._special.search(text):
            return self._special.split(text)
        return [text]

    def _learn(self, pieces: set[str], known: dict[str, int]) -> None:
        missing = list(pieces.difference(known))
        pre = [self._pre_tokens(m) for m in missing]
        distinct = list(set().union(*pre))
        size = dict(zip(distinct, self.merges.counts(distinct).tolist()))
        known.update((m, sum(map(size.__getitem__, p))) for m, p in zip(missing, pre))

    def count(self, texts: list[str | None]) -> list[int]:
        """Number of tokens of each text; null and empty ones have none."""
        if not hasattr(self, "_later"):
            self._start()
        if len(self._later) + len(self._first) > CACHE_ENTRIES:
            self._later, self._first = {}, {}
        later, first = self._later, self._first
        out = [0] * len(texts)
        cut: list[tuple[int, list[str]]] = []
        for i, text in enumerate(texts):
            if text:
                parts = self._parts(text)
                out[i] += len(parts) - 1
                cut += [(i, p.split(" ")) for p in parts if p]
        words = set().union(*(p[1:] for _, p in cut)).difference(later)
        whole = {w for w in words if not cuts_cleanly(w)}
        words -= whole
        firsts = {p[0] for _, p in cut}
        odd = {w for w in firsts if not cuts_cleanly(w)}
        firsts -= odd
        for n, (i, p) in enumerate(cut):  # texts with white space beside a space stay in one piece
            if p[0] in odd or (whole and not whole.isdisjoint(p[1:])):
                cut[n] = (i, [" ".join(p)])
                firsts.add(cut[n][1][0])
        self._learn({" " + w for w in words}, spaced := {})
        later.update((w[1:], c) for w, c in spaced.items())
        self._learn(firsts, first)
        for i, p in cut:
            out[i] += first[p[0]] + sum(map(later.__getitem__, p[1:]))
        for _, p in cut:
            if len(p) == 1 and len(p[0]) > 1000:
                first.pop(p[0], None)
        return out


def counter(spark: SparkSession, path: str):
    """The counter of a tokenizer file, broadcast (bounded by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(Counter(json.load(f)))


#: Texts whose missing pieces are merged together.
TEXTS_AT_ONCE = 512


def count_tokens(text: Column, shared) -> Column:
    """long: number of tokens of each text; 0 for null and empty texts."""

    @F.arrow_udf("long")
    def counted(texts: pa.Array) -> pa.Array:
        out: list[int] = []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            out += shared.value.count(texts.slice(at, TEXTS_AT_ONCE).to_pylist())
        return pa.array(out, pa.int64())

    return counted(text)
