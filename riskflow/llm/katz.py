"""Language-model scores by Katz backoff.

    P(w | h) = d(c) * c(h, w) / c(h)      where (h, w) was seen in training
             = alpha(h) * P(w | h')       where it was not; h' is h without its first word
             = P(w | h')                  where h itself was not seen

Counts c up to ``MOST_DISCOUNTED`` are discounted by Good-Turing; alpha(h) hands
what they lose to the words not seen after h, so every distribution sums to one
over the training vocabulary and one unknown word.  Below single words all that
is left belongs to the unknown word.  A history none of whose counts is small
enough to be discounted counts one more, or nothing would be left to back off to.

The model is a set of tables partitioned by history, one table a level.  Texts
are never joined with them token by token:

1. Documents become blocks of about ``BLOCK_TOKENS`` tokens, numbered within
   the block and written once.
2. Level by level, a block sends each partition its *distinct* n-grams with
   their counts in training rows, as packed columns.  The partition adds up all
   blocks' counts, which makes its part of the level's table, and answers every
   block in the order it was asked: each n-gram's count and number and each
   history's discounted and lower-level mass.
3. With the answers of all levels a block evaluates its tokens recursively.

A word that follows often, as a history, has its successors dealt to as many
partitions as its count calls for; the number of partitions follows the number
of tokens, so what one task holds does not grow with the data.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .common import staged

ORDER = 2
MOST_DISCOUNTED = 5
BLOCK_TOKENS = 3 << 18
PART_TOKENS = 1 << 21  # tokens whose n-grams one partition of a table counts
HISTORY_TOKENS = 1 << 20  # occurrences of a history whose successors one partition takes
LEAST_PARTS = 8
PIECE_BYTES = 4 << 20  # of a text whose words are held at once
ADDED = 0.1  # to every count of the base score

_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: No word holds a space, so these stand for no word.
_START, _END = b" start", b" end"
#: Number of the history before a text: only starts of texts.
_AT_START = 0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: bytes | None) -> Iterator[tuple[list[bytes], bool]]:
    """(words, whether these are the last) of a text with A-Z lower-cased.
    ``split`` cuts at the six bytes 0x20 and 0x09-0x0D, as the words' pattern."""
    text, at = (text or b"").translate(_LOWER), 0
    while True:
        end = at + PIECE_BYTES
        while end < len(text) and text[end] not in b" \t\n\v\f\r":
            end += 1
        yield text[at:end].split(), end >= len(text)
        if end >= len(text):
            return
        at = end


def pack(values: np.ndarray) -> bytes:
    """Whole numbers from 0 on as compressed byte planes, those of high bytes
    that are all zero left out."""
    values = np.ascontiguousarray(values, "<u8")
    width = (int(values.max()).bit_length() + 7) // 8 if len(values) else 0
    planes = values.view(np.uint8).reshape(-1, 8)[:, :width].T
    return struct.pack("<qB", len(values), width) + zstandard.compress(planes.tobytes(), 3)


def unpack(data: bytes) -> np.ndarray:
    n, width = struct.unpack_from("<qB", data)
    out = np.zeros((n, 8), np.uint8)
    if n and width:
        out[:, :width] = np.frombuffer(zstandard.decompress(data[9:]), np.uint8).reshape(width, n).T
    return out.view("<u8").reshape(-1).astype(np.int64)


def pack_floats(values: np.ndarray) -> bytes:
    """Floats of which few differ: the different ones and which is where."""
    kinds, at = np.unique(values, return_inverse=True)
    data = pack(at)
    return struct.pack("<q", len(data)) + data + kinds.astype("<f8").tobytes()


def unpack_floats(data: bytes) -> np.ndarray:
    (size,) = struct.unpack_from("<q", data)
    return np.frombuffer(data[8 + size :], "<f8")[unpack(data[8 : 8 + size])]


def discounts(seen: np.ndarray) -> np.ndarray:
    """d(r) of r = 0 ... MOST_DISCOUNTED (the first unused), from the number of
    n-grams seen r times, r = 1 ... MOST_DISCOUNTED + 1.  Good-Turing where it
    gives numbers between 0 and 1 for all r, else an absolute discount."""
    k = MOST_DISCOUNTED
    n = np.r_[0.0, seen[: k + 1]]
    r = np.arange(1, k + 1)
    d = np.full(k + 1, 1.0)
    if (n[1:] > 0).all():
        common = (k + 1) * n[k + 1] / n[1]
        if common < 1:
            d[1:] = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            if ((d[1:] > 0) & (d[1:] < 1)).all():
                return d
    off = min(0.9, max(0.1, n[1] / (n[1] + 2 * n[2]))) if n[1] + n[2] > 0 else 0.5
    d[1:] = 1 - off / r
    return d


def discounted(count: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) * c."""
    return count * np.where(count <= MOST_DISCOUNTED, d[np.minimum(count, MOST_DISCOUNTED)], 1.0)


# --- blocks -----------------------------------------------------------------

#: A piece is a text or a stretch of one; ``lead`` of its tokens are only the
#: history of those that follow.
_BLOCK = T.StructType([
    T.StructField("block", T.LongType()), T.StructField("row", T.ArrayType(T.LongType())),
    T.StructField("held", T.ArrayType(T.BooleanType())), T.StructField("lead", T.ArrayType(T.IntegerType())),
    T.StructField("size", T.ArrayType(T.IntegerType())), T.StructField("tokens", T.BinaryType()),
    T.StructField("words", T.BinaryType()),
    T.StructField("order", T.BinaryType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_starts", T.LongType()),
])


class _Numbers(dict):
    """Numbers for words in the order they are first asked for."""

    def __missing__(self, word):
        self[word] = n = len(self)
        return n


class _Writer:
    """Collects pieces into a block."""

    def __init__(self, order: int):
        self.order, self.numbers = order, _Numbers()
        self.number = self.numbers.__getitem__
        self.number(_START)  # local number 0
        self.row, self.ids, self.held, self.lead, self.size, self.tokens, self.n = [], [], [], [], [], [], 0
        self.starts = self.taught = 0

    def add(self, row, doc_id, held, history: list[bytes], words: list[bytes], first: bool) -> None:
        self.tokens.append(np.fromiter(map(self.number, history + words), np.int64, len(history) + len(words)))
        self.row.append(row), self.ids.append(doc_id), self.held.append(held)
        self.lead.append(len(history)), self.size.append(len(history) + len(words))
        self.n += len(words)
        if not held:
            self.taught += len(words)
            self.starts += first

    def columns(self) -> list:
        hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in self.numbers), np.uint64, len(self.numbers))
        return [self.row, self.held, self.lead, self.size, pack(np.concatenate(self.tokens)), hashes.tobytes(),
                pack(np.argsort(hashes[1:], kind="stable") + 1), self.taught, self.starts, self.ids]


def blocks(docs: DataFrame, doc_id: str, text: str, held: Column, order: int = ORDER) -> DataFrame:
    """(block, pieces, tokens by local number, hashes of the local words,
    training tokens and texts, ids)."""
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).withColumn("held", held)
    kind = T.StructType([*_BLOCK.fields, T.StructField("ids", T.ArrayType(rows.schema["doc_id"].dataType))])

    def run(batches):
        schema = to_arrow_schema(kind)
        task = TaskContext.get().partitionId() << 36
        row, number, writer = task, task, _Writer(order)

        def written():
            values = [number, *writer.columns()]
            return pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(values, schema)], schema=schema)

        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, data, out in zip(ids, batch.column(1).cast(pa.large_binary()).to_pylist(), batch.column(2).to_pylist()):
                history, first = [_START] * (order - 1), True
                for words, last in words_of(data):
                    writer.add(row, i, out, history, words + [_END] * last, first)
                    history, first = (history + words)[len(history + words) - order + 1 :], False
                    if writer.n >= BLOCK_TOKENS:
                        yield written()
                        number, writer = number + 1, _Writer(order)
                row += 1
        if writer.row:
            yield written()

    return rows.mapInArrow(run, kind)


# --- what a block asks and is told --------------------------------------------

def _packed(numbers: dict, *names: str) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in numbers.items()] + [T.StructField(n, T.BinaryType()) for n in names])


_PART = {"part": T.IntegerType(), "block": T.LongType(), "level": T.IntegerType()}
REQUEST = _packed(_PART, "history", "run", "word", "count", "lower", "wanted")
REPLY = _packed({"kind": T.IntegerType(), **_PART}, "count", "number", "seen", "mass", "lower")


class Constants:
    """What is known of the whole corpus: a few numbers a level."""

    def __init__(self, order: int, parts: int, starts: int):
        self.order, self.parts, self.starts = order, parts, starts
        self.tokens = self.kinds = 0  # training tokens and different ones
        self.d: dict[int, np.ndarray] = {}  # by level

    def learn(self, level: int, seen: np.ndarray, kinds: int, tokens: int) -> None:
        self.d[level] = discounts(seen)
        if level == 1:
            self.tokens, self.kinds = tokens, kinds
            mass = discounted(np.arange(1, MOST_DISCOUNTED + 1), self.d[1]) @ seen[:MOST_DISCOUNTED]
            rest = tokens - np.arange(1, MOST_DISCOUNTED + 1) @ seen[:MOST_DISCOUNTED]
            self.size = tokens + (0 if seen[:MOST_DISCOUNTED].any() else 1)  # nothing discounted: one more
            self.unknown = 1 - (mass + rest) / self.size

    def single(self, count: np.ndarray) -> np.ndarray:
        """P of single words by their training count."""
        return np.where(count > 0, discounted(count, self.d[1]) / self.size, self.unknown)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.uint64) * _MIX
    x ^= x >> np.uint64(29)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    return (x ^ (x >> np.uint64(32))) >> np.uint64(1)


class Block:
    """A block's tokens, replayed level by level."""

    def __init__(self, r):
        self.r, self.block = r, int(r.block)
        self.tokens = unpack(r.tokens)
        self.order = unpack(r.order)  # the local words by their hashes
        size, lead = np.asarray(r.size, np.int64), np.asarray(r.lead, np.int64)
        self.piece = np.repeat(np.arange(len(size)), size)
        start = np.cumsum(size) - size
        nth = np.arange(len(self.tokens)) - start[self.piece]
        self.new = nth >= lead[self.piece]
        self.follows = (nth > 0) & (self.tokens > 0)  # has a token before it in its piece, and is a word
        held = np.asarray(r.held, bool)[self.piece]
        self.taught, self.backs_off = self.new & ~held, self.new & held
        #: Of the n-gram of the level at hand that ends in each token: its number
        #: and count; a number below 0 is none.
        self.number = self.count = None

    def ask_single(self, parts: int) -> Iterator[dict]:
        """Asks each partition about the words in its range of hashes, in their
        order; the only step that needs the hashes themselves."""
        words = np.frombuffer(self.r.words, np.uint64)[self.order]
        count = np.bincount(self.tokens[self.taught], minlength=len(self.order) + 1)[self.order]
        part = ((words >> np.uint64(32)) * np.uint64(parts) >> np.uint64(32)).astype(np.int64)
        edge = np.searchsorted(part, np.arange(parts + 1))
        for p in range(parts):
            if edge[p] < edge[p + 1]:
                mine = slice(edge[p], edge[p + 1])
                yield {"part": p, "word": words[mine].tobytes(), "count": pack(count[mine])}

    def told_single(self, replies: dict, c: Constants) -> None:
        number, count = np.full(len(self.order) + 1, -1, np.int64), np.zeros(len(self.order) + 1, np.int64)
        # partitions are ranges of hashes, so their answers end to end are in the words' order
        told = [replies[p] for p in sorted(replies)]
        count[self.order] = np.concatenate([unpack(r.count) for r in told] or [np.empty(0, np.int64)])
        number[self.order] = np.concatenate([unpack(r.number) for r in told] or [np.empty(0, np.int64)])
        number[count == 0] = -1
        number[0], count[0] = _AT_START, c.starts
        self.word, self.word_count = number[self.tokens], count[self.tokens]
        self.number, self.count = self.word, self.word_count
        self.p = c.single(self.word_count)

    def pairs(self, c: Constants):
        """The different (history, word) pairs of the level above: for each its
        partition, numbers, and one token where it stands; and which pair each
        asked token is.  Ordered by partition, history, word."""
        history = np.r_[-1, self.number[:-1]]
        size = np.r_[0, self.count[:-1]]
        asked = np.flatnonzero(self.follows & (history >= 0) & (size > 0))
        h, w = history[asked], self.word[asked]
        hs, hi = np.unique(h, return_inverse=True)
        key = hi * (int(self.tokens.max(initial=0)) + 1) + self.tokens[asked]
        _, first, which = np.unique(key, return_index=True, return_inverse=True)
        h, w, size = h[first], w[first], size[asked][first]
        split = np.minimum(-(-size // HISTORY_TOKENS), c.parts)
        sub = (_mixed(w + 1) % split.astype(np.uint64)).astype(np.int64)
        part = ((_mixed(h) % np.uint64(c.parts)).astype(np.int64) + sub) % c.parts
        order = np.lexsort((w, h, part))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        wanted = np.zeros(len(hs), bool)  # histories that held-out texts have: only they can back off
        wanted[hi[self.backs_off[asked]]] = True
        wanted = wanted[hi[first]][order]
        return asked, back[which], part[order], h[order], w[order], size[order], wanted

    def requests(self, c: Constants):
        """Per partition: its pairs, its histories, and where each one's pairs
        begin.  Histories dealt to several partitions ask each of them."""
        asked, which, part, h, w, size, wanted = self.pairs(c)
        home = (_mixed(h) % np.uint64(c.parts)).astype(np.int64)
        split = np.minimum(-(-size // HISTORY_TOKENS), c.parts)
        # every history once for each of its partitions, pairs or not
        hs, at = np.unique(h, return_index=True)
        many = np.repeat(np.arange(len(hs)), split[at])
        nth = np.arange(len(many)) - np.repeat(np.cumsum(split[at]) - split[at], split[at])
        hp, hh = (home[at][many] + nth) % c.parts, hs[many]
        order = np.lexsort((hh, hp))
        hp, hh, hw = hp[order], hh[order], wanted[at][many][order]
        edges = np.searchsorted(part, np.arange(c.parts + 1)), np.searchsorted(hp, np.arange(c.parts + 1))
        out = []
        for p in range(c.parts):
            pairs, histories = slice(edges[0][p], edges[0][p + 1]), slice(edges[1][p], edges[1][p + 1])
            if histories.start < histories.stop:
                run = np.searchsorted(h[pairs], hh[histories], "right") - np.searchsorted(h[pairs], hh[histories], "left")
                out.append((p, pairs, hh[histories], hw[histories], run))
        return asked, which, h, w, out

    def ask(self, c: Constants) -> Iterator[dict]:
        asked, which, h, w, out = self.requests(c)
        known = w >= 0  # no pair with an unknown word was ever seen
        count = np.bincount(which[self.taught[asked]], minlength=len(h))
        lower = np.zeros(len(h))
        lower[which] = self.p[asked]
        for p, pairs, histories, wanted, run in out:
            mine = known[pairs]
            run = np.add.reduceat(np.append(mine.astype(np.int64), 0), np.cumsum(run) - run) * (run > 0)
            yield {
                "part": p, "history": pack(np.diff(histories, prepend=0)), "run": pack(run), "word": pack(w[pairs][mine]),
                "count": pack(count[pairs][mine]), "lower": pack_floats(lower[pairs][mine]), "wanted": pack(wanted),
            }

    def told(self, replies: dict, level: int, c: Constants) -> None:
        asked, which, h, w, out = self.requests(c)
        d = c.d[level]
        count, number = np.zeros(len(h), np.int64), np.full(len(h), -1, np.int64)
        hs = np.unique(h)
        seen, mass, low = np.zeros(len(hs), bool), np.zeros(len(hs)), np.zeros(len(hs))
        for p, pairs, histories, wanted, _ in out:
            r = replies[p]
            at = np.flatnonzero(w[pairs] >= 0) + pairs.start
            count[at] = unpack(r.count)
            if r.number is not None:
                number[at] = unpack(r.number)
            where = np.searchsorted(hs, histories)
            seen[where] |= unpack(r.seen) > 0
            few = np.frombuffer(r.mass, "<i8").reshape(-1, MOST_DISCOUNTED + 1)
            mass[where[wanted]] += few[:, :-1] @ discounted(np.arange(1, MOST_DISCOUNTED + 1), d) + few[:, -1]
            low[where[wanted]] += np.frombuffer(r.lower, "<f8")
        size = np.r_[0, self.count[:-1]][asked]
        of = np.searchsorted(hs, h)[which]
        size = size + np.where(seen[of], 0, 1)  # nothing discounted: one more
        got = count[which]
        alpha = (1 - mass[of] / size) / np.maximum(1 - low[of], 1e-300)
        self.p[asked] = np.where(got > 0, discounted(got, d) / size, alpha * self.p[asked])
        ends, counts = np.full(len(self.tokens), -1, np.int64), np.zeros(len(self.tokens), np.int64)
        ends[asked], counts[asked] = number[which], got
        ends[counts == 0] = -1
        start = self.tokens == 0
        ends[start], counts[start] = _AT_START, c.starts
        self.number, self.count = ends, counts

    def result(self, c: Constants) -> pd.DataFrame:
        known = self.word_count > 0
        base = np.log10((self.word_count + ADDED) / (c.tokens + ADDED * (c.kinds + 1)))
        n = len(self.r.row)
        of = self.piece[self.new]
        total = lambda x: np.bincount(of, x[self.new], minlength=n)
        return pd.DataFrame({
            "row": self.r.row, "doc_id": pd.Series(list(self.r.ids), dtype=object), "held_out": self.r.held,
            "n_tokens": np.bincount(of, minlength=n), "n_known": total(known).astype(np.int64),
            "base_score": total(base), "score": total(np.log10(self.p)),
        })


# --- partitions ----------------------------------------------------------------


def _count_single(parts: int):
    """Adds up a partition's single words: answers, and its part of the table."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable")
        part = int(rows.part.iloc[0])
        words = [np.frombuffer(w, np.uint64) for w in rows.word]
        kinds, at = np.unique(np.concatenate(words), return_inverse=True)
        count = np.bincount(at, np.concatenate([unpack(c) for c in rows["count"]]), minlength=len(kinds)).astype(np.int64)
        rank = np.empty(len(kinds), np.int64)
        rank[np.argsort(-count, kind="stable")] = np.arange(len(kinds))
        number = 1 + rank * parts + part  # frequent words get small numbers, which pack well
        edge = np.r_[0, np.cumsum([len(w) for w in words])]
        out = [
            {"kind": 0, "part": part, "block": b, "level": 1, "count": pack(count[at[x:y]]), "number": pack(number[at[x:y]])}
            for b, x, y in zip(rows.block, edge[:-1], edge[1:])
        ]
        some = count > 0
        table = {"kind": 1, "part": part, "level": 1, "count": pack(count[some]), "number": pack(number[some]), "seen": kinds[some].tobytes()}
        return _replies([*out, table, _sizes(part, 1, count[some])])

    return run


def _count_pairs(level: int, parts: int, last: bool):
    """Adds up a partition's (history, word) pairs of a level."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("block", kind="stable")
        part = int(rows.part.iloc[0])
        histories = [np.cumsum(unpack(h)) for h in rows.history]
        runs = [unpack(r) for r in rows.run]
        h = np.concatenate([np.repeat(x, r) for x, r in zip(histories, runs)])
        words = [unpack(w) for w in rows.word]
        w = np.concatenate(words)
        own = np.concatenate([unpack(c) for c in rows["count"]])
        lower = np.concatenate([unpack_floats(x) for x in rows.lower])
        order = np.lexsort((w, h))
        change = np.r_[True, (h[order][1:] != h[order][:-1]) | (w[order][1:] != w[order][:-1])][: len(order)]
        first = np.flatnonzero(change)
        pair = np.empty(len(order), np.int64)
        pair[order] = np.cumsum(change) - 1
        count = np.bincount(pair, own, minlength=len(first)).astype(np.int64)
        ph, pw, pl = h[order][first], w[order][first], lower[order][first]
        some = count > 0
        number = np.full(len(first), 0, np.int64)
        number[some] = 1 + np.arange(some.sum()) * parts + part
        hs, of = np.unique(ph[some], return_inverse=True)
        few = np.zeros((len(hs) + 1, MOST_DISCOUNTED + 1), np.int64)  # the last row: histories without any pair here
        c = count[some]
        np.add.at(few, (of, np.minimum(c, MOST_DISCOUNTED + 1) - 1), np.where(c > MOST_DISCOUNTED, c, 1))
        low = np.r_[np.bincount(of, pl[some], minlength=len(hs)), 0.0]
        discounted_any = few[:, :-1].any(axis=1)
        edge = np.r_[0, np.cumsum([len(x) for x in words])]
        out = []
        for i, (block, asked) in enumerate(zip(rows.block, histories)):
            at = np.minimum(np.searchsorted(hs, asked), max(0, len(hs) - 1))
            at = np.where(hs[at] == asked, at, len(hs)) if len(hs) else np.zeros(len(asked), np.int64)
            want = at[unpack(rows.wanted.iloc[i]) > 0]
            mine = pair[edge[i] : edge[i + 1]]
            out.append({
                "kind": 0, "part": part, "block": block, "level": level, "count": pack(count[mine]),
                "number": None if last else pack(number[mine]), "seen": pack(discounted_any[at]),
                "mass": few[want].astype("<i8").tobytes(), "lower": low[want].astype("<f8").tobytes(),
            })
        table = {
            "kind": 1, "part": part, "level": level, "count": pack(c), "number": None if last else pack(number[some]),
            "seen": pack(np.diff(ph[some], prepend=0)), "mass": pack(pw[some]),
        }
        return _replies([*out, table, _sizes(part, level, c)])

    return run


def _sizes(part: int, level: int, count: np.ndarray) -> dict:
    """How many n-grams were seen 1, 2, ... times, how many in all, and how often."""
    n = np.bincount(np.minimum(count, MOST_DISCOUNTED + 2), minlength=MOST_DISCOUNTED + 3)[1 : MOST_DISCOUNTED + 2]
    return {"kind": 2, "part": part, "level": level, "count": np.r_[n, len(count), count.sum()].astype("<i8").tobytes()}


def _replies(rows: list[dict]) -> pd.DataFrame:
    columns = REPLY.names
    got = pd.DataFrame(rows, columns=columns)
    for c in ("kind", "part", "block", "level"):
        got[c] = got[c].fillna(-1).astype(np.int64)
    return got.astype(object).where(got.notna(), None)


def _mail(order: int):
    """The replies of a block by level and partition."""

    def by_level(replies: pd.DataFrame) -> dict:
        found: dict = {level: {} for level in range(1, order + 1)}
        for r in replies.itertuples(index=False):
            found[r.level][r.part] = r
        return found

    return by_level


def _replayed(row, replies: pd.DataFrame, c: Constants, levels: int) -> Block:
    b, told = Block(row), _mail(c.order)(replies)
    b.told_single(told[1], c)
    for level in range(2, levels + 1):
        b.told(told[level], level, c)
    return b


class Model:
    """The fitted tables (``tables``: one row a partition and level, packed
    columns), and what is needed to score the blocks they were fitted with."""

    def __init__(self, blocks: DataFrame, mail: list[DataFrame], constants: Constants):
        self.blocks, self.mail, self.constants = blocks, mail, constants

    @property
    def tables(self) -> DataFrame:
        rows = self.mail[0]
        for m in self.mail[1:]:
            rows = rows.unionByName(m)
        return rows.where("kind = 1").drop("kind", "block")

    def _replies(self) -> DataFrame:
        rows = self.mail[0].where("kind = 0")
        for m in self.mail[1:]:
            rows = rows.unionByName(m.where("kind = 0"))
        return rows

    def _by_block(self, run, schema) -> DataFrame:
        return self.blocks.drop("words").groupBy("block").cogroup(self._replies().groupBy("block")).applyInPandas(run, schema)

    def requests(self) -> DataFrame:
        """What every block asks of the next level."""
        c, level = self.constants, len(self.mail) + 1
        columns = REQUEST.names

        def ask(block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            asked = []
            for row in block.itertuples(index=False):
                b = _replayed(row, replies, c, level - 1)
                asked += [{"block": b.block, "level": level, **r} for r in b.ask(c)]
            return pd.DataFrame(asked, columns=columns)

        return self._by_block(ask, REQUEST)

    def scores(self) -> DataFrame:
        """One row a piece: row, doc_id, held_out, n_tokens, n_known, base_score, score."""
        c = self.constants
        id_type = self.blocks.schema["ids"].dataType.elementType
        kind = T.StructType().add("row", "long").add("doc_id", id_type).add("held_out", "boolean").add("n_tokens", "long")
        kind = kind.add("n_known", "long").add("base_score", "double").add("score", "double")

        def score(block: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
            got = [_replayed(row, replies, c, c.order).result(c) for row in block.itertuples(index=False)]
            return pd.concat(got) if got else pd.DataFrame(columns=[f.name for f in kind.fields])

        return self._by_block(score, kind)


def fit(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> Model:
    """Counts the n-grams of the rows that are not ``held`` (a condition on
    ``doc_id``), level by level."""
    encoded = staged(blocks(docs, doc_id, text, held, order), "blocks")
    size = encoded.agg(F.sum("n_tokens").alias("tokens"), F.sum("n_starts").alias("starts")).first()
    parts = max(LEAST_PARTS, math.ceil((size.tokens or 0) / PART_TOKENS))
    c = Constants(order, parts, size.starts or 0)
    columns = REQUEST.names

    def first(batches):
        for batch in batches:
            for row in batch.to_pandas().itertuples(index=False):
                b = Block(row)
                asked = [{"block": b.block, "level": 1, **r} for r in b.ask_single(parts)]
                if asked:
                    got = pd.DataFrame(asked, columns=columns)
                    yield pa.RecordBatch.from_pandas(got.astype(object).where(got.notna(), None), schema=request, preserve_index=False)

    request = to_arrow_schema(REQUEST)
    model = Model(encoded, [], c)
    for level in range(1, order + 1):
        asked = encoded.mapInArrow(first, REQUEST) if level == 1 else model.requests()
        count = _count_single(parts) if level == 1 else _count_pairs(level, parts, level == order)
        model.mail.append(staged(asked.groupBy("part").applyInPandas(count, REPLY), f"level{level}"))
        # a few numbers a partition
        sizes = [np.frombuffer(r["count"], "<i8") for r in model.mail[-1].where("kind = 2").select("count").collect()]
        total = np.sum([np.zeros(MOST_DISCOUNTED + 3, np.int64), *sizes], axis=0)
        c.learn(level, total[:-2], int(total[-2]), int(total[-1]))
    return model


def score(docs: DataFrame, held: Column, doc_id: str = "doc_id", text: str = "text", order: int = ORDER) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known,
    train_tokens, base_score, score (log10 probabilities of the whole text).

    Null and empty texts are one end token.  Repeated rows are texts of their
    own and teach as often as they occur.  Without a training row every token is
    the unknown word, with probability one.  An empty table gives an empty
    result.  Words are told apart by 64-bit hashes."""
    model = fit(docs, held, doc_id, text, order)
    pieces = model.scores()
    sums = [F.sum(x).alias(x) for x in ("n_tokens", "n_known", "base_score", "score")]
    got = pieces.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *sums)
    tokens = F.lit(model.constants.tokens).cast("long").alias("train_tokens")
    return got.select("doc_id", "held_out", "n_tokens", "n_known", tokens, "base_score", "score")


def held_tenth(doc_id: str = "doc_id") -> Column:
    """True when crc32 of the id as text is divisible by 10 (a null id counts as
    the empty text, which is)."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))) % 10) == 0


def _discounts_sql(name: str, counts: str) -> str:
    """DuckDB: a one-row table of a level's discounts, as a list by count."""
    return f"""{name}_n AS (SELECT list_transform([1, 2, 3, 4, 5, 6], lambda r: coalesce(len(list_filter(cs, lambda x: x = r)), 0)::DOUBLE) AS n
  FROM (SELECT list(c) AS cs FROM {counts} WHERE c <= 6)),
{name}_gt AS (SELECT n, 6 * n[6] / nullif(n[1], 0) AS common, CASE WHEN n[1] + n[2] > 0 THEN least(0.9, greatest(0.1, n[1] / (n[1] + 2 * n[2]))) ELSE 0.5 END AS off FROM {name}_n),
{name}_l AS (SELECT off, list_min(n) > 0 AND common < 1 AS usable, list_transform([1, 2, 3, 4, 5],
    lambda r: ((r + 1) * n[r + 1] / nullif(n[r], 0) / r - common) / nullif(1 - common, 0)) AS gt FROM {name}_gt),
{name} AS (SELECT CASE WHEN usable AND list_min(gt) > 0 AND list_max(gt) < 1 THEN gt
    ELSE list_transform([1, 2, 3, 4, 5], lambda r: 1 - off / r) END AS d FROM {name}_l)"""


_ID_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) * 4),
    lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(h, (i // 4 + 1)::INT, 2))::BIGINT ELSE 0::BIGINT END)),
  lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(3988292384::BIGINT, xor(c, b) // 2) ELSE xor(c, b) // 2 END))"""
#: DuckDB SQL of ``score`` at order 2.
ORACLE = rf"""
WITH docs AS (
  SELECT doc_id, row_number() OVER () AS row, hex(encode(coalesce(doc_id::VARCHAR, ''))) AS h, list_append(regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' end') AS words FROM documents),
d AS (SELECT doc_id, row, words, {_ID_CRC} % 10 = 0 AS held FROM docs),
tok AS (
  SELECT row, held, p.v AS v, p.w AS w FROM (
    SELECT row, held, unnest(list_transform(range(1, len(words) + 1), lambda i: {{'v': CASE WHEN i = 1 THEN ' start' ELSE words[i - 1] END, 'w': words[i]}})) AS p FROM d)),
uni AS (SELECT w, count(*) AS c FROM tok WHERE NOT held GROUP BY w),
bi AS (SELECT v, w, count(*) AS c FROM tok WHERE NOT held GROUP BY v, w),
{_discounts_sql("d1", "uni")},
{_discounts_sql("d2", "bi")},
size AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS kinds, coalesce(min(c), 6) AS smallest FROM uni),
p1 AS (SELECT w, c, CASE WHEN c <= 5 THEN d1.d[c] ELSE 1 END * c / (n + CASE WHEN smallest <= 5 THEN 0 ELSE 1 END) AS p FROM uni, size, d1),
unknown AS (SELECT 1 - coalesce(sum(p), 0) AS p FROM p1),
p2 AS (SELECT v, w, bi.c, CASE WHEN bi.c <= 5 THEN d2.d[bi.c] ELSE 1 END * bi.c AS mass, p1.p AS lower FROM bi JOIN p1 USING (w), d2),
history AS (
  SELECT v, sum(c) + CASE WHEN min(c) <= 5 THEN 0 ELSE 1 END AS size,
    (1 - sum(mass) / (sum(c) + CASE WHEN min(c) <= 5 THEN 0 ELSE 1 END)) / (1 - sum(lower)) AS alpha FROM p2 GROUP BY v),
scored AS (
  SELECT row, count(*) AS n_tokens, count(p1.c) AS n_known, sum(log10((coalesce(p1.c, 0) + 0.1) / (n + 0.1 * (kinds + 1)))) AS base_score,
    sum(log10(CASE WHEN p2.mass IS NOT NULL THEN p2.mass / history.size ELSE coalesce(alpha, 1) * coalesce(p1.p, unknown.p) END)) AS score
  FROM tok LEFT JOIN p1 USING (w) LEFT JOIN p2 ON p2.v = tok.v AND p2.w = tok.w LEFT JOIN history ON history.v = tok.v, size, unknown
  GROUP BY row)
SELECT doc_id, held AS held_out, n_tokens, n_known, n AS train_tokens, base_score, score FROM scored JOIN d USING (row), size
"""
