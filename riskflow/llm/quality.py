"""Quality classifier: hashed word n-gram logistic regression, trained with
follow-the-regularised-leader updates and scored as sparse dot products.

A text becomes words and runs of signs.  Its features are hashed 1- and 2-grams
of the words, and 1- to 3-grams of their normal forms (case pattern, the first
eight signs of a sign run, or "same as the word before"), so words never seen
still count; the words themselves are hashed whole.  The
vector of counts has length one.

Training uses at most ``ROWS_PER_CLASS`` labelled rows of each class (the ones
with the smallest id hashes, whatever the number of labels), dealt to a fixed
number of shards; each shard runs FTRL over its rows and the weights are
averaged.  The intercept is moved to the class rates of all labels that may
teach, before the limit a class.
Scoring is a narrow map over every whole text.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, held_out

BITS = 18
ROWS_PER_CLASS = 6000
SHARDS = 8
UPDATES, MOST_EPOCHS = 10_000, 60  # rounds over a shard's rows go on up to these
ALPHA, BETA, L1, L2 = 0.3, 1.0, 1e-4, 1e-4
THRESHOLD = 0.3
#: Characters of text whose words are held at once; longer texts go in pieces.
PIECE_CHARS = 1 << 20
#: Hashes of a long text's n-grams held before they become counts.
FOLD_GRAMS = 4 << 20
#: Words whose hashes a Python worker keeps; beyond it the cache starts anew.
CACHE_WORDS = 250_000

_WORDS = re.compile(r"\w+|[^\w\s]+").findall
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_TOP = np.uint64(64 - BITS)
_SAME = np.uint64(xxhash.xxh64_intdigest(b"\x00same"))
_codes: dict[str, tuple[int, int]] = {}


def _code(word: str) -> tuple[int, int]:
    """Hashes of a word and of its normal form."""
    if word[0].isalnum() or word[0] == "_":
        if word.isdigit():
            form = "9"
        elif word.islower():
            form = "x"
        elif word.isupper():
            form = "X" if len(word) > 1 else "I"
        elif word[0].isupper() and word[1:].islower():
            form = "Xx"
        else:
            form = "m"
    else:
        form = word[:8]
    return xxhash.xxh64_intdigest(word.lower()), xxhash.xxh64_intdigest("\x00" + form)


def _word_lists(text: str) -> Iterator[list[str]]:
    at = 0
    while at < len(text):
        end = at + PIECE_CHARS
        while end < len(text) and not text[end].isspace():
            end += 1
        yield _WORDS(text[at:end])
        at = end


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(indices, values) of a text's vector of length one; empty texts have
    none."""
    found: list[np.ndarray] = []  # hashes, uint64
    folded: list[np.ndarray] = []  # counts of earlier ones, int64: never joined with hashes, as both together turn to float
    word = form = np.empty(0, np.uint64)
    for words in _word_lists(text or ""):
        if not words:
            continue
        if len(_codes) > CACHE_WORDS:
            _codes.clear()
        got = []
        for w in words:
            c = _codes.get(w)
            if c is None:
                c = _codes[w] = _code(w)
            got.append(c)
        both = np.array(got, np.uint64)
        old = len(word)  # the last words of the piece before, for n-grams across the cut
        word, form = np.concatenate([word, both[:, 0]]), np.concatenate([form, both[:, 1]])
        same = np.flatnonzero(word[1:] == word[:-1]) + 1
        form[same[same >= old]] = _SAME
        new = slice(old, None)
        found += [word[new] * _M1, form[new] * _M2]
        for grams, salt in ((word, _M3), (form, _M1)):
            pair = (grams[:-1] * _M2 + grams[1:]) * salt
            found.append(pair[max(old - 1, 0) :])
        triple = ((form[:-2] * _M2 + form[1:-1]) * _M3 + form[2:]) * _M2
        found.append(triple[max(old - 2, 0) :])
        if len(text) > PIECE_CHARS:  # fold what has been found, to hold one piece's n-grams only
            found = [np.concatenate(found)]
            if len(found[0]) > FOLD_GRAMS:
                folded, found = _fold([*folded, *found]), []
        word, form = word[-2:], form[-2:]
    if not found and not folded:
        return np.empty(0, np.int64), np.empty(0)
    index = np.concatenate([np.empty(0, np.uint64), *found])
    at, count = np.unique((index >> _TOP).astype(np.int64), return_counts=True)
    if folded:
        dense = folded[0]
        dense[at] += count
        at = np.flatnonzero(dense)
        count = dense[at]
    return at, count / math.sqrt(float((count.astype(np.float64) ** 2).sum()))


def _fold(found: list[np.ndarray]) -> list[np.ndarray]:
    """Counts by feature (int64) in place of the hashes found so far."""
    dense = np.zeros(1 << BITS, np.int64)
    for f in found:
        dense += f if f.dtype == np.int64 else np.bincount((f >> _TOP).astype(np.int64), minlength=1 << BITS)
    return [dense]


class FTRL:
    """Logistic regression by FTRL-proximal; the last weight is the intercept."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, x: np.ndarray, y: int, weight: float = 1.0) -> None:
        at, x = np.append(at, len(self.z) - 1), np.append(x, 1.0)
        w = self.weights(at)
        g = (1 / (1 + math.exp(-max(-35.0, min(35.0, float(w @ x))))) - y) * weight * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def _train_shard(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["at", "y"], kind="stable")
    data = [(*features(t), int(y)) for t, y in zip(rows.text, rows.y)]
    model = FTRL(1 << BITS)
    size = rows.y.value_counts()
    weight = {y: len(rows) / (len(size) * n) for y, n in size.items()}  # both classes count the same
    for _ in range(min(MOST_EPOCHS, math.ceil(UPDATES / len(data)))):
        for at, x, y in data:
            model.learn(at, x, y, weight[y])
    return pd.DataFrame({"w": [model.weights().astype(np.float32).tobytes()]})


def taught(labels: DataFrame) -> DataFrame:
    """(id, y), one row per document, of the labels that may teach.  Documents
    whose labels contradict each other, null labels, null ids and held-out rows
    teach nothing; a repeated label teaches once."""
    return (
        labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("y")).where("y in (0, 1) and id is not null")
        .groupBy("id").agg(F.min("y").alias("y"), F.max("y").alias("most")).where("y = most").drop("most")
        .where(~held_out("id"))
    )


def training_sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, rows_per_class: int) -> DataFrame:
    """(y, at, text) of the bounded training sample, of documents that ``taught``
    names; a repeated document teaches once."""
    said = taught(labels).withColumn("at", F.xxhash64("id"))
    picked = [said.where(F.col("y") == c).orderBy("at", "id").limit(rows_per_class) for c in (0, 1)]
    chosen = F.broadcast(picked[0].unionByName(picked[1]))  # at most 2 * rows_per_class rows
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(chosen, "id")
    return rows.groupBy("id", "y", "at").agg(F.min("text").alias("text")).drop("id")


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text",
    rows_per_class: int = ROWS_PER_CLASS,
) -> np.ndarray:
    """Weights (2 ** BITS and the intercept, float32).  Without any labelled row
    all are zero; with one class the intercept alone tells."""
    sample = training_sample(docs, labels, doc_id, text, rows_per_class)
    shards = sample.withColumn("shard", F.pmod(F.col("at"), F.lit(SHARDS))).groupBy("shard")
    found = [np.frombuffer(r.w, np.float32) for r in shards.applyInPandas(_train_shard, "w binary").collect()]
    if not found:
        return np.zeros((1 << BITS) + 1, np.float32)
    w = np.mean(found, axis=0, dtype=np.float64)
    count = {r["y"]: r["count"] for r in taught(labels).groupBy("y").count().collect()}
    bad, good = count.get(0, 0), count.get(1, 0)
    w[-1] += math.log((good + 1) / (bad + 1))  # the shards saw balanced classes
    return w.astype(np.float32)


def score(text: Column, weights) -> Column:
    """double from 0 to 1: how likely a text is good.  ``weights`` is a
    broadcast; null and empty texts score by the intercept."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        w = weights.value
        margin = np.full(len(texts), float(w[-1]))
        for i, x in enumerate(texts):
            at, values = features(x.as_py())
            margin[i] += float(w[at].astype(np.float64) @ values)
        return pa.array(1 / (1 + np.exp(-np.clip(margin, -700, 700))))

    return scored(text)


def classify(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted (1 where the
    score reaches the threshold).  An empty table gives an empty result."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id, text))
    got = docs.select(F.col(doc_id).alias("doc_id"), score(F.col(text), weights).alias("score"))
    return got.select(
        "doc_id", held_out("doc_id").alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted")
    )


def keep_good(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs`` that the classifier does not reject, as they are."""
    weights = docs.sparkSession.sparkContext.broadcast(train(docs, labels, doc_id, text))
    name = fresh(docs, "score")
    return docs.withColumn(name, score(F.col(text), weights)).where(F.col(name) >= threshold).drop(name)
