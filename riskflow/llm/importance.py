"""Importance resampling towards a target distribution, by batch concatenation.

A text's features are its runs of 1 to ``n`` words, hashed to buckets by CRC-32.
The texts of a batch are joined with a separator between them, so one pass of a
pattern finds all words of all texts; the documents' offsets, searched for each
word's start, tell whose word it is and mask the runs that would cross from one
document into the next, before the rest is counted with ``bincount``.

Corpus and target are each counted in one pass (a task adds up its own buckets
before anything is shuffled).  A bucket's gain is the logarithm of its smoothed
target share over its corpus share; a document's weight is the sum of gains over
its features; the draw takes the highest weights after Gumbel noise that depends
on the document's id only, which is sampling without replacement.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.running import row_numbers
from .common import staged

BUCKETS = 10_000
MOST_WORDS = 1  # of a feature
LEAST_WORDS = 20  # of a document that can be drawn
PERCENT = 10  # of those documents that are drawn
SEED = "2024"
#: Bytes of text that are joined at once; a longer text goes in pieces.
CHUNK_BYTES = 1 << 21

#: The signs of words, as UTF-8 bytes after lower-casing A-Z.  Any
#: byte from 0x80 on is part of a letter or sign beyond ASCII, so the pattern
#: on bytes finds what [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ finds on characters.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_SENTINEL = b"\n"


def _pieces(text: bytes, n: int) -> Iterator[tuple[bytes, int]]:
    """(piece, words at its start that only serve as context): a text in pieces
    of about ``CHUNK_BYTES``, cut between words, each led by the last ``n - 1``
    words of what came before."""
    at, lead = 0, []
    while at < len(text):
        end = at + CHUNK_BYTES
        if end < len(text):
            inside = _WORDS.match(text, end)  # a word that goes on at the cut
            end = inside.end() if inside else end
        piece = text[at:end]
        yield _SENTINEL.join([*lead, piece]), len(lead)
        if n > 1 and end < len(text):
            lead = (lead + _WORDS.findall(piece))[1 - n :]
        at = end


def _chunks(texts: list[bytes | None], n: int) -> Iterator[tuple[np.ndarray, list[bytes], np.ndarray]]:
    """(documents, pieces, context words of each) to join at once."""
    docs, held, skip, size = [], [], [], 0
    for i, text in enumerate(texts):
        for piece, lead in _pieces((text or b"").translate(_LOWER), n):
            docs.append(i), held.append(piece), skip.append(lead)
            size += len(piece)
            if size >= CHUNK_BYTES:
                yield np.array(docs), held, np.array(skip)
                docs, held, skip, size = [], [], [], 0
    if held:
        yield np.array(docs), held, np.array(skip)


def features(texts: list[bytes | None], n: int = MOST_WORDS, buckets: int = BUCKETS):
    """(number of texts, buckets, owners, words) of each chunk: the bucket and
    the text of every feature, and the number of words of every text."""
    for docs, pieces, skip in _chunks(texts, n):
        starts = np.cumsum([0] + [len(p) + 1 for p in pieces[:-1]])
        found = list(_WORDS.finditer(_SENTINEL.join(pieces)))
        words = [m[0] for m in found]
        owner = np.searchsorted(starts, [m.start() for m in found], side="right") - 1
        nth = np.arange(len(words)) - np.searchsorted(owner, owner, side="left")  # of its piece
        new = nth >= skip[owner]
        hashes = np.fromiter(map(crc32, words), np.int64, len(words))
        got, whose = [hashes[new]], [owner[new]]
        spaced = [b" " + w for w in words] if n > 1 else []
        for length in range(2, n + 1):
            # a run's checksum goes on from that of the run without its last word
            hashes = np.fromiter(map(crc32, spaced[length - 1 :], hashes[: len(words) - length + 1].tolist()), np.int64)
            first, last = owner[: len(hashes)], owner[length - 1 :]
            inside = (first == last) & new[length - 1 :]
            got.append(hashes[inside]), whose.append(first[inside])
        yield docs[np.concatenate(whose)], np.concatenate(got) % buckets, np.bincount(docs[owner[new]], minlength=len(texts))


def _bytes(texts: pa.Array) -> list[bytes | None]:
    return texts.cast(pa.large_binary()).to_pylist()


def bucket_counts(rows: DataFrame, text: str, n: int, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts: every task counts its own
    rows, the sums are one number a bucket."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, found, _ in features(_bytes(batch.column(0)), n, buckets):
                total += np.bincount(found, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    found = rows.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in found.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's smoothed target share over its corpus share."""
    s, t, size = corpus.astype(np.float64), target.astype(np.float64), len(corpus)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + size) / ((s + 1) * (t.sum() + size)))).astype(np.int64)


def weigh(text: Column, shared, n: int = MOST_WORDS) -> Column:
    """struct of n_words, n_features and weight of each text, by the broadcast
    gains; all 0 for null and empty texts."""
    kind = pa.struct([("n_words", pa.int64()), ("n_features", pa.int64()), ("weight", pa.int64())])

    @F.arrow_udf("struct<n_words: long, n_features: long, weight: long>")
    def weighed(texts: pa.Array) -> pa.Array:
        gain, size = shared.value, len(texts)
        sums = np.zeros((3, size), np.int64)
        for whose, found, words in features(_bytes(texts), n, len(gain)):
            sums[0] += words
            sums[1] += np.bincount(whose, minlength=size)
            # whole numbers far below 2^53: the sums in doubles are exact
            sums[2] += np.bincount(whose, gain[found], minlength=size).astype(np.int64)
        return pa.StructArray.from_arrays([pa.array(x) for x in sums], fields=list(kind))

    return weighed(text)


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """Gumbel noise in thousandths, from a digest of the seed and the id (a null
    id counts as the empty text)."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(
    docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    n: int = MOST_WORDS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: str = SEED,
) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_features, weight, score,
    rank (1, 2, ... of the drawn ones, else null).

    Null and empty texts have no feature and weight 0.  Ties go to the smaller
    doc_id, a null id last; repeated rows are documents of their own, with equal
    scores.  An empty target leaves only the smoothing; an empty ``docs`` gives an
    empty result."""
    gain = gains(bucket_counts(docs, text, n, buckets), bucket_counts(target, target_text, n, buckets))
    shared = docs.sparkSession.sparkContext.broadcast(gain)  # ``buckets`` numbers
    got = docs.select(F.col(doc_id).alias("doc_id"), weigh(F.col(text).cast("string"), shared, n).alias("got"))
    got = got.select("doc_id", "got.*").withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    got = staged(got, "weighed")
    can = F.col("n_words") >= least_words
    drawn = percent * got.where(can).count() // 100
    ranked = row_numbers(got.where(can), [F.desc("score"), F.asc_nulls_last("doc_id")], out="rank")
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= drawn, F.col("rank")))
    return ranked.unionByName(got.where(~can).withColumn("rank", F.lit(None).cast("long")))


_WORD_LIST = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_WORD_LIST} AS words FROM documents),
dw AS (SELECT row, unnest(words) AS word FROM d),
bw AS (SELECT unnest({_WORD_LIST}) AS word FROM benchmark),
names AS (SELECT word, hex(encode(word)) AS h FROM (SELECT word FROM dw UNION SELECT word FROM bw)),
-- the checksum bit by bit: each byte joins before the first of its eight steps
bucket AS (
  SELECT word, xor(4294967295, list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(0, length(h) * 4),
      lambda i: CASE WHEN i % 8 = 0 THEN ('0x' || substr(h, (i // 4 + 1)::INT, 2))::BIGINT ELSE 0::BIGINT END)),
    lambda c, b: CASE WHEN xor(c, b) % 2 = 1 THEN xor(3988292384::BIGINT, xor(c, b) // 2) ELSE xor(c, b) // 2 END)) % 10000 AS bucket
  FROM names),
s AS (SELECT bucket, count(*) AS s FROM dw JOIN bucket USING (word) GROUP BY 1),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN bucket USING (word) GROUP BY 1),
size AS (SELECT (SELECT count(*) FROM dw) AS all_s, (SELECT count(*) FROM bw) AS all_t),
gain AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (all_s + 10000) / ((s + 1)::DOUBLE * (all_t + 10000))))::BIGINT AS gain
  FROM s LEFT JOIN t USING (bucket), size),
weights AS (SELECT row, sum(gain)::BIGINT AS weight FROM dw JOIN bucket USING (word) JOIN gain USING (bucket) GROUP BY row),
scored AS (
  SELECT doc_id, row, len(words)::BIGINT AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN weights USING (row)),
ranked AS (
  SELECT row, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score,
  CASE WHEN rank <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN rank END AS rank
FROM scored LEFT JOIN ranked USING (row)
"""
