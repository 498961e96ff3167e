"""SimHash near-duplicates found by deletion-variant signatures.

A fingerprint of 64 bits is cut into two segments of 32.  Two fingerprints
within three bits then agree, in at least one segment, up to a single bit, so
they share one of that segment's 32 one-wildcard variants (the segment with
one bit deleted).  Variants are the equality keys; whatever meets under a key
is verified by the bit distance.

Scale: equal fingerprints collapse to one row first, so copies cost nothing.
Keys that hold one fingerprint (nearly all) go in the JVM by a count over the
key.  A key that many different fingerprints share is cut again by one-wildcard
variants of the other segment's halves, which bounds it (two such keys fix 46
of 64 bits) and deals it to many tasks.  Inside a key a breadth-first walk
gives a spanning forest, never all pairs.  Fingerprints, links and components
stay distributed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import graph
from .common import fresh, staged

SHINGLE_WORDS = 3
MAX_BITS = 3
SEGMENT_BITS = 32
#: Keys with more fingerprints are cut by variants of the other segment.
WIDE_KEY = 2048
#: Bytes of text whose shingles are held at once; longer texts go in pieces.
PIECE_BYTES = 1 << 20


def _word_pieces(data: bytes, words: int):
    """Lists of consecutive words; each list repeats the last ``words - 1`` of
    the one before, so every shingle lies in exactly one list."""
    if len(data) <= PIECE_BYTES:
        yield data.split()
        return
    tail: list[bytes] = []
    start = 0
    while start < len(data):
        end = min(start + PIECE_BYTES, len(data))
        while end < len(data) and data[end] not in b" \t\n\r\x0b\x0c":
            end += 1
        got = tail + data[start:end].split()
        if len(got) >= words or end >= len(data):
            yield got
            tail = got[len(got) - words + 1 :] if words > 1 else []
        else:
            tail = got
        start = end


def fingerprint(text: str | None, words: int = SHINGLE_WORDS) -> int:
    """SimHash of the text's word shingles (ASCII letters in lower case, words
    cut at ASCII white space, repeats counted); a bit is set where over half
    the shingle hashes set it.  Fewer words: their whole sequence; none: zero."""
    if not text:
        return 0
    data = text.encode("utf-8", "surrogatepass").lower()  # bytes: A-Z only
    ones, total = np.zeros(64, np.int64), 0
    digest = xxhash.xxh64_intdigest
    for got in _word_pieces(data, words):
        if len(got) >= words:
            grams = map(b" ".join, zip(*(got[i:] for i in range(words))))
        elif total or not got:
            continue
        else:
            grams = iter([b" ".join(got)])
        hashes = np.array([digest(g, 42) for g in grams], np.uint64)
        total += len(hashes)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    if not total:
        return 0
    return int(np.packbits(2 * ones > total, bitorder="little").view(np.uint64)[0])


def fingerprints(text: Column, words: int = SHINGLE_WORDS) -> Column:
    """The fingerprint as a signed long."""

    @F.arrow_udf("long")
    def simhash(texts: pa.Array) -> pa.Array:
        got = np.array([fingerprint(x.as_py(), words) for x in texts], np.uint64)
        return pa.array(got.view(np.int64))

    return simhash(text)


def _wildcards(segment: Column, bits: int) -> Column:
    """An array of the segment's ``bits`` variants: (position, segment with the
    bit at that position deleted) packed into one long."""
    mask = [((1 << bits) - 1) ^ (1 << i) for i in range(bits)]
    return F.array(*[segment.bitwiseAND(F.lit(m)) + F.lit(i << bits) for i, m in enumerate(mask)])


def _variants(prints: DataFrame) -> DataFrame:
    """(key, fp): every one-wildcard variant of both segments."""
    low = F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    high = F.shiftrightunsigned("fp", SEGMENT_BITS)
    away = F.lit(1 << 40)  # keeps the two segments' keys apart
    keys = F.concat(
        _wildcards(low, SEGMENT_BITS),
        F.transform(_wildcards(high, SEGMENT_BITS), lambda k: k + away),
    )
    return prints.select("fp", F.explode(keys).alias("key"))


def _sub_keys() -> Column:
    """Variants of the halves of the segment that the key does not cover; a
    narrow key keeps one sub-key."""
    other = F.when(F.col("key") < (1 << 40), F.shiftrightunsigned("fp", SEGMENT_BITS)).otherwise(
        F.col("fp").bitwiseAND(F.lit((1 << SEGMENT_BITS) - 1))
    )
    half = SEGMENT_BITS // 2
    first = _wildcards(other.bitwiseAND(F.lit((1 << half) - 1)), half)
    second = F.transform(_wildcards(F.shiftrightunsigned(other, half), half), lambda k: k + F.lit(1 << 30))
    return F.when(F.col("members") > WIDE_KEY, F.concat(first, second)).otherwise(F.array(F.lit(-1).cast("long")))


def _forest(prints: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Edges of a spanning forest of the fingerprints (uint64, distinct) within
    ``max_bits``: breadth first, each fingerprint taken once."""
    left, edges = prints, []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = np.bitwise_count(left ^ at) <= max_bits
            if near.any():
                found = left[near]
                edges.extend((at, x) for x in found)
                queue.extend(found)
                left = left[~near]
        if not len(left):
            break
    return edges


def _links(max_bits: int):
    """Over rows sorted by (key, sub): forest edges of each run of equal keys."""

    def run(batches):
        held_key, held = None, []

        def close(key, parts):
            prints = np.unique(np.concatenate(parts))
            return _forest(prints, max_bits) if len(prints) > 1 else []

        seen: set[tuple[int, int]] = set()
        for b in batches:
            key = np.stack([b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)])
            fp = b.column(2).to_numpy(zero_copy_only=False).view(np.uint64)
            if not len(fp):
                continue
            cuts = np.flatnonzero((key[:, 1:] != key[:, :-1]).any(axis=0)) + 1
            bounds = np.concatenate([[0], cuts, [len(fp)]])
            size = np.diff(bounds)
            # runs of two that lie inside the batch: all at once
            inner = np.arange(len(size))
            pair = (size == 2) & (inner > 0) & (inner < len(size) - 1)
            x, y = fp[bounds[:-1][pair]], fp[bounds[:-1][pair] + 1]
            ok = (np.bitwise_count(x ^ y) <= max_bits) & (x != y)
            found = list(zip(x[ok].tolist(), y[ok].tolist()))
            for i in np.flatnonzero(~pair):
                part = fp[bounds[i] : bounds[i + 1]]
                k = (int(key[0, bounds[i]]), int(key[1, bounds[i]]))
                if k != held_key:
                    if held:
                        found.extend(close(held_key, held))
                    held_key, held = k, []
                held.append(part)
            fresh_ones = {(int(min(e)), int(max(e))) for e in found} - seen
            if len(seen) > 200_000:
                seen.clear()
            seen |= fresh_ones
            yield _edges(fresh_ones)
        if held:
            yield _edges({(int(min(e)), int(max(e))) for e in close(held_key, held)} - seen)

    return run


def _edges(found) -> pa.RecordBatch:
    at = np.array(list(found), np.uint64).reshape(-1, 2).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(at[:, 0]), pa.array(at[:, 1])], names=["a", "b"])


def links(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(a, b): edges between different fingerprints (column ``fp``) that span
    exactly the groups linked at ``max_bits`` or fewer differing bits.

    ``max_bits`` may be up to 3: two segments then leave at most one bit in one
    of them."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments cover at most three differing bits")
    by_key = Window.partitionBy("key")
    shared = _variants(prints).withColumn("members", F.count(F.lit(1)).over(by_key)).where("members > 1")
    dealt = shared.select("key", F.explode(_sub_keys()).alias("sub"), "fp").repartition("key", "sub")
    return dealt.sortWithinPartitions("key", "sub").mapInArrow(_links(max_bits), "a long, b long").distinct()


def groups(prints: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(fp, component_id, first_fp) for every distinct fingerprint of ``prints``
    (doc_id, fp): the smallest doc_id whose fingerprint is reachable, and the
    fingerprint of that document."""
    distinct = prints.groupBy("fp").agg(F.min("doc_id").alias("low"))
    roots = staged(graph.components(links(distinct.select("fp"), max_bits), "a", "b"), "roots")
    least = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select(
        "fp", "low", F.coalesce("root", "fp").alias("root")
    )
    first = least.groupBy("root").agg(F.min(F.struct(F.col("low").isNull().alias("none"), "low", "fp")).alias("first"))
    named = least.select("fp", "root").join(first, "root")
    return staged(
        named.select("fp", F.col("first.low").alias("component_id"), F.col("first.fp").alias("first_fp")), "simhash-groups"
    )


def near_duplicates(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """One row per input row: (doc_id, fp long, component_id).

    component_id is the smallest doc_id whose fingerprint is reachable by links
    of ``max_bits`` or fewer bits, itself included.  Null, empty and blank texts
    have fingerprint zero and link like any other.  A null doc_id keeps its row
    and never becomes a component_id unless no row of the component has an id
    (then null).  An empty table gives an empty result.
    """
    prints = staged(docs.select(F.col(doc_id).alias("doc_id"), fingerprints(F.col(text), words).alias("fp")), "simhash")
    return prints.join(groups(prints, max_bits), "fp").select("doc_id", "fp", "component_id")


def keep_first(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
    words: int = SHINGLE_WORDS, max_bits: int = MAX_BITS,
) -> DataFrame:
    """The rows of ``docs`` as they are, but of each group of near copies only
    the one with the smallest doc_id (a row without id only where no row of the
    group has one; one of rows that repeat both id and fingerprint)."""
    fp, first, low = fresh(docs, "fp"), fresh(docs, "first"), fresh(docs, "low")
    marked = staged(docs.withColumn(fp, fingerprints(F.col(text), words)), "marked")
    found = groups(marked.select(F.col(doc_id).alias("doc_id"), F.col(fp).alias("fp")), max_bits)
    keep = found.where(F.col("fp") == F.col("first_fp")).select(
        F.col("fp").alias(first), F.col("component_id").alias(low)
    )
    kept = marked.join(keep, (F.col(fp) == F.col(first)) & F.col(doc_id).eqNullSafe(F.col(low)), "left_semi")
    return kept.dropDuplicates([fp, doc_id]).drop(fp)


def hex_print(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))
