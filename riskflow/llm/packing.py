"""Best-fit packing of documents into sequences by non-negative least squares
over length patterns.

The histogram of piece lengths (at most ``max_tokens`` numbers, whatever the
number of documents) is all that the driver sees.  Patterns of one to three
lengths that fill a sequence exactly are enumerated, their repeat counts fitted
to the histogram by non-negative least squares and rounded down; what is left is
packed by best fit, again as patterns with repeat counts.  So the plan's size
depends on the number of different lengths, not on the data.

Pieces find their place by their rank among the pieces of the same length.
Ranks come from counts per (length, hash bucket): no task sorts all pieces of a
length, so a length that a third of all pieces share is dealt out too.
"""

from __future__ import annotations

import math
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import CACHE_ENTRIES, staged

MAX_TOKENS = 4096
END_ID = 1
#: Triples kept for each largest length; steps of the least-squares fit.
TRIPLES, STEPS = 8, 300


class WordIds:
    """Ids of a tokenizer whose words never cross ASCII white space and which
    lowers the case first; each distinct word is encoded once by the library."""

    def __init__(self, spec: str):
        self.spec = spec

    def __getstate__(self):
        return {"spec": self.spec}

    def _start(self):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_str(self.spec)
        self._words: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> None:
        missing = list(words)
        found = self._library.encode_batch_fast([w.decode() for w in missing], add_special_tokens=False)
        self._words.update((w, np.array(e.ids, np.uint32).tobytes()) for w, e in zip(missing, found))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian uint32."""
        if not hasattr(self, "_words"):
            self._start()
        if len(self._words) > CACHE_ENTRIES:
            self._words.clear()
        cut = []
        for t in texts:
            data = (t or "").encode()
            # lower case does not change the ids, but could make a special token of "<|"
            cut.append((data if b"<|" in data else data.lower()).split())
        self._learn(set().union(*cut).difference(self._words))
        known = self._words
        return [b"".join(map(known.__getitem__, words)) for words in cut]


def word_ids(spark: SparkSession, path: str):
    """The tokenizer file, broadcast (bounded by the vocabulary)."""
    with open(path, encoding="utf-8") as f:
        return spark.sparkContext.broadcast(WordIds(f.read()))


TEXTS_AT_ONCE = 512


def pieces(text: Column, shared, max_tokens: int = MAX_TOKENS) -> Column:
    """array of struct(piece, start, length, ids_crc32): the text's ids and the
    end id, cut into pieces of ``max_tokens``; null and empty texts have the end
    id alone."""

    @F.arrow_udf("array<struct<piece: int, start: long, length: long, ids_crc32: long>>")
    def cut(texts: pa.Array) -> pa.Array:
        ends, rows = [0], []
        for at in range(0, len(texts), TEXTS_AT_ONCE):
            for data in shared.value.encode(texts.slice(at, TEXTS_AT_ONCE).to_pylist()):
                data += END_ID.to_bytes(4, "little")
                n = len(data) // 4
                view = memoryview(data)
                for piece, start in enumerate(range(0, n, max_tokens)):
                    length = min(max_tokens, n - start)
                    rows.append((piece, start, length, zlib.crc32(view[4 * start : 4 * (start + length)])))
                ends.append(len(rows))
        flat = np.array(rows, np.int64).reshape(-1, 4)
        fields = [pa.array(flat[:, 0].astype(np.int32)), *(pa.array(flat[:, i]) for i in (1, 2, 3))]
        items = pa.StructArray.from_arrays(fields, names=["piece", "start", "length", "ids_crc32"])
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), items)

    return cut(text)


def enumerate_patterns(have: np.ndarray, capacity: int) -> np.ndarray:
    """Rows of three lengths (0: none) that fill ``capacity`` exactly, of the
    lengths with ``have`` > 0: singles, all pairs, and for each largest length
    the triples whose scarcest length is most frequent."""
    out = []
    lengths = np.flatnonzero(have)
    for big in lengths[::-1]:
        rest = capacity - big
        if rest == 0:
            out.append((big, 0, 0))
            continue
        if rest <= big and have[rest]:
            out.append((big, rest, 0))
        a = lengths[(lengths <= min(big, rest - 1)) & (lengths >= rest - lengths)]
        a = a[(rest - a <= big) & (have[rest - a] > 0)] if len(a) else a
        if len(a):
            least = np.minimum(have[a], have[rest - a])
            for x in a[np.argsort(-least, kind="stable")[:TRIPLES]]:
                out.append((big, x, rest - x))
    return np.array(out, np.int64).reshape(-1, 3)


def fit_counts(patterns: np.ndarray, have: np.ndarray) -> np.ndarray:
    """Repeat counts x >= 0 that minimise the squared distance between the
    lengths used and the histogram (accelerated projected gradient)."""
    if not len(patterns):
        return np.zeros(0)
    n = len(have)
    used = patterns > 0
    flat, owner = patterns[used], np.nonzero(used)[0]
    scale = float(have.max())
    target = have / scale

    def forward(x):
        return np.bincount(flat, weights=x[owner], minlength=n)

    def backward(r):
        return np.bincount(owner, weights=r[flat], minlength=len(patterns))

    v = np.ones(len(patterns))
    for _ in range(20):  # largest eigenvalue, for the step
        v = backward(forward(v))
        top = np.linalg.norm(v)
        v /= top
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(STEPS):
        new = np.maximum(0.0, y - backward(forward(y) - target) / (1.05 * top))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y, x, t = new + (t - 1) / t2 * (new - x), new, t2
    return x * scale


def _best_fill(left: np.ndarray, room: int, pairs: bool) -> list[int]:
    """Lengths that fill ``room``: each time the longest that fits or, with
    ``pairs``, two that fill it exactly where there are such."""
    out: list[int] = []
    while room > 0:
        low = np.flatnonzero(left[1 : room + 1]) + 1
        if not len(low):
            return out
        take = [int(low[-1])]
        if pairs and low[-1] < room:
            both = low[left[room - low] > (room - low == low)]
            if len(both):
                take = [int(both[-1]), int(room - both[-1])]
        for x in take:
            left[x] -= 1
            room -= x
        out += take
    return out


def _choose(have: np.ndarray, capacity: int, patterns: np.ndarray, pairs: bool) -> list[tuple[list[int], int]]:
    """(lengths, repeats) that use up the histogram: the fitted patterns, then
    best fit of the residuals."""
    left = have.astype(np.int64).copy()
    chosen: list[tuple[list[int], int]] = []
    for p, n in zip(patterns.tolist(), np.floor(fit_counts(patterns, have) + 1e-9).astype(np.int64).tolist()):
        lengths = [x for x in p if x]
        n = min([n, *(int(left[x]) // lengths.count(x) for x in set(lengths))])
        if n > 0:
            chosen.append((lengths, n))
            for x in lengths:
                left[x] -= n
    while left.any():
        big = int(np.flatnonzero(left)[-1])
        trial = left.copy()
        trial[big] -= 1
        lengths = [big, *_best_fill(trial, capacity - big, pairs)]
        n = min(int(left[x]) // lengths.count(x) for x in set(lengths))
        chosen.append((lengths, n))
        for x in lengths:
            left[x] -= n
    return chosen


def plan(have: np.ndarray, capacity: int) -> dict[str, np.ndarray]:
    """Blocks of equal places, for a histogram ``have`` (index: length).

    A block gives the pieces of one ``length`` with ranks from ``rank`` on to
    ``repeats`` sequences from ``sequence`` on, in turn, at ``offset`` and, where
    a pattern holds the length several times, at multiples of the length after
    it.  Patterns of two lengths alone, and of up to three, are both fitted, each
    with two ways to fill residuals; the plan with the fewest sequences stays."""
    patterns = enumerate_patterns(have, capacity)
    short = patterns[patterns[:, 2] == 0]
    plans = [_choose(have, capacity, p, pairs) for p in (patterns, short) for pairs in (True, False)]
    chosen = min(plans, key=lambda c: sum(n for _, n in c))
    rows, ranks, sequence = [], np.zeros(len(have), np.int64), 0
    for lengths, n in chosen:
        offset = 0
        for x in sorted(set(lengths), reverse=True):
            times = lengths.count(x)
            rows.append((x, int(ranks[x]), n, sequence, offset))
            ranks[x] += n * times
            offset += x * times
        sequence += n
    rows.sort()
    cols = np.array(rows, np.int64).reshape(-1, 5).T
    return dict(zip(("length", "rank", "repeats", "sequence", "offset"), cols))


def _place(length: Column, rank: Column, blocks) -> Column:
    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        b, n, r = blocks.value, lengths.to_numpy(zero_copy_only=False), ranks.to_numpy(zero_copy_only=False)
        at = np.searchsorted(b["key"], (n << 44) + r, side="right") - 1
        i = r - b["rank"][at]
        sequence = b["sequence"][at] + i % b["repeats"][at]
        offset = b["offset"][at] + i // b["repeats"][at] * n
        return pa.StructArray.from_arrays([pa.array(sequence), pa.array(offset)], names=["sequence_id", "offset"])

    return placed(length, rank)


def pack(docs: DataFrame, shared, doc_id: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id,
    offset.  No sequence is longer than ``max_tokens``, its pieces lie without a
    gap from 0 on, and only documents longer than that are cut.

    Null and empty texts are one piece of one id.  A null doc_id is kept as it
    is; repeated rows are packed each.  An empty table gives an empty result."""
    spark = docs.sparkSession
    cut = docs.select(F.col(doc_id).alias("doc_id"), F.explode(pieces(F.col(text), shared, max_tokens)).alias("p"))
    cut = staged(cut.select("doc_id", "p.*"), "pieces")
    counts = {r["length"]: r["count"] for r in cut.groupBy("length").count().collect()}  # at most max_tokens rows
    have = np.zeros(max_tokens + 1, np.int64)
    have[list(counts)] = list(counts.values())
    blocks = plan(have, max_tokens)
    blocks["key"] = (blocks["length"] << 44) + blocks["rank"]
    # ranks within a length: a running sum over hash buckets, then within a bucket;
    # as many buckets as rows in one, so neither window grows with the table
    buckets = max(1, math.isqrt(int(have.sum())))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    sizes = cut.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    inside = Window.partitionBy("length", "bucket").orderBy(*order)
    ranked = cut.withColumn("nth", F.row_number().over(inside) - 1).join(sizes, ["length", "bucket"])
    place = _place(F.col("length"), F.col("before") + F.col("nth"), spark.sparkContext.broadcast(blocks))
    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", place.alias("at")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "at.sequence_id", "at.offset"
    )
