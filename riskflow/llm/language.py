"""Language ID by string kernels.

The kernel of two texts is the number of character n-grams (one to three
characters, the blended spectrum) that both contain, divided by the root of the
product of their own numbers: presence, not counts.  N-grams are hashed and
kept to those that a bounded training sample knows.  Nyström landmarks (training
texts of every language) map a text to its kernel values with them, whitened by
the landmarks' own kernel matrix, and one ridge regression per language (one
versus the rest) is solved over the sample.

Scoring is a narrow map: presence rows of a batch times the landmarks' presence
matrix, then times the weights.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fresh, held_out

BITS = 18
TRAIN_PER_LANGUAGE = 400  # training rows of a language, the smallest id hashes
LANDMARKS_PER_LANGUAGE = 48
LEAST_TEXTS = 3  # an n-gram is kept when this many training texts have it
RIDGE = 0.05
UNKNOWN = "und"
#: Rows of one matrix product, and characters whose n-grams are held at once.
BATCH_ROWS, PIECE_CHARS = 64, 1 << 20

_LETTER = regex.compile(r"\p{L}").search
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+").sub
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_TOP = np.uint64(64 - BITS)


def _buckets(text: str, seen: np.ndarray) -> None:
    """Marks the hashed 1- to 3-grams of a text's letters (lower case, anything
    else one space) in ``seen``."""
    tail = " "
    for at in range(0, len(text), PIECE_CHARS):
        part = _NOT_LETTERS(" ", text[at : at + PIECE_CHARS].lower())
        if tail[-1] == " " and part[0] == " ":
            part = part[1:]
        if at + PIECE_CHARS >= len(text) and (tail + part)[-1] != " ":
            part += " "
        part = tail + part
        code = np.frombuffer(part.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        one = code * _M[0] + _M[1]
        two = (code[:-1] * _M[1] + code[1:]) * _M[2] + _M[0]
        three = ((code[:-2] * _M[0] + code[1:-1]) * _M[1] + code[2:]) * _M[2]
        for grams in (one, two * _M[0], three):
            seen[(grams >> _TOP).astype(np.int64)] = True
        tail = part[-2:]


def presence(text: str | None) -> np.ndarray:
    """The sorted hashed n-grams of a whole text."""
    seen = np.zeros(1 << BITS, bool)
    _buckets(text or "", seen)
    return np.flatnonzero(seen)


class Model:
    """Fitted on (text, lang) rows, in their order."""

    def __init__(self, texts: list[str], langs: list[str]):
        self.langs = sorted(set(langs))
        sets = [presence(t) for t in texts]
        df = np.bincount(np.concatenate([*sets, np.empty(0, np.int64)]), minlength=1 << BITS)
        kept = np.flatnonzero(df >= min(LEAST_TEXTS, len(texts)))
        self.kept = kept
        self.column = np.full(1 << BITS, -1, np.int32)
        self.column[kept] = np.arange(len(kept), dtype=np.int32)
        self.size = len(kept)
        y = np.array([self.langs.index(x) for x in langs])
        per = [np.flatnonzero(y == c)[:LANDMARKS_PER_LANGUAGE] for c in range(len(self.langs))]
        self.landmarks = self._rows([sets[i] for i in np.concatenate(per)])
        self.root = np.sqrt(np.maximum(self.landmarks.sum(axis=1), 1))
        own = self._kernel(self.landmarks)
        value, vector = np.linalg.eigh(own.astype(np.float64))
        good = value > 1e-6 * value.max()
        whiten = vector[:, good] / np.sqrt(value[good])
        z = np.concatenate([self._kernel(self._rows(sets[i : i + BATCH_ROWS])) for i in range(0, len(sets), BATCH_ROWS)]) @ whiten
        target = np.where(y[:, None] == np.arange(len(self.langs)), 1.0, -1.0)
        weight = (1 / np.bincount(y))[y][:, None] * len(y) / len(self.langs)  # every language counts the same
        solved = np.linalg.solve(z.T @ (weight * z) + RIDGE * np.eye(z.shape[1]), z.T @ (weight * target))
        self.weights = whiten @ solved

    def _rows(self, sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), self.size), np.float32)
        for i, s in enumerate(sets):
            at = self.column[s]
            out[i, at[at >= 0]] = 1
        return out

    def _kernel(self, rows: np.ndarray) -> np.ndarray:
        shared = rows @ self.landmarks.T
        return shared / (np.sqrt(np.maximum(rows.sum(axis=1), 1))[:, None] * self.root)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        seen = np.zeros(1 << BITS, bool)
        some = [i for i, t in enumerate(texts) if t and _LETTER(t)] if self.langs else []
        for at in range(0, len(some), BATCH_ROWS):
            part = some[at : at + BATCH_ROWS]
            rows = np.zeros((len(part), self.size), np.float32)
            for r, i in enumerate(part):
                _buckets(texts[i], seen)
                rows[r] = seen[self.kept]
                seen[:] = False
            value = self._kernel(rows) @ self.weights
            best = value.argmax(axis=1)
            for r, i in enumerate(part):
                langs[i] = self.langs[best[r]]
                scores[i] = min(1.0, max(0.0, (value[r, best[r]] + 1) / 2))
        return langs, scores


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["at", "lang", "text"], kind="stable")
    return pd.DataFrame({"model": [pickle.dumps(Model(list(rows.text), list(rows.lang)))]})


def train(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model | None:
    """The model of a bounded sample: TRAIN_PER_LANGUAGE rows of each language,
    the ones with the smallest id hashes among all that are not held out and
    have a language and a letter.  None where there is no such row."""
    rows = docs.select(F.col(doc_id).alias("id"), F.col(lang).alias("lang"), F.col(text).alias("text"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out("id"))
    ids = rows.groupBy("id").agg(F.min("lang").alias("lang"), F.max("lang").alias("last")).where("lang = last")
    by_lang = Window.partitionBy("lang").orderBy("at", "id")
    ids = ids.select("id", "lang", F.xxhash64("id").alias("at"))
    # of a large language only hashes low enough for about twice the sample meet in its window
    sizes = F.broadcast(ids.groupBy(F.col("lang").alias("of")).agg(F.count(F.lit(1)).alias("n")))  # one row a language
    share = F.col("at") / F.lit(2.0**64) + 0.5
    ids = ids.join(sizes, F.col("lang") == F.col("of")).where(share * F.col("n") < 2 * TRAIN_PER_LANGUAGE + 100)
    ids = ids.select("id", "lang", "at")
    ids = ids.withColumn("n", F.row_number().over(by_lang)).where(F.col("n") <= TRAIN_PER_LANGUAGE).drop("n")
    # bounded by TRAIN_PER_LANGUAGE times the number of languages
    sample = rows.select("id", "text").join(F.broadcast(ids), "id").groupBy("id", "lang", "at").agg(F.min("text").alias("text"))
    found = sample.groupBy(F.lit(0).alias("all")).applyInPandas(_fit, "model binary").collect()
    return pickle.loads(found[0].model) if found else None


def predict(text: Column, model) -> Column:
    """struct(lang, score); ``model`` is a broadcast of a Model or None."""

    @F.arrow_udf("struct<lang: string, score: double>")
    def predicted(texts: pa.Array) -> pa.Array:
        if model.value is None:
            langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
        else:
            langs, scores = model.value.predict(texts.to_pylist())
        return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(scores)], names=["lang", "score"])

    return predicted(text)


def identify(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.  Null texts and
    texts without a letter are ``und`` with score 0, as is every text where
    nothing could be learned.  An empty table gives an empty result."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, doc_id, text, lang))
    got = docs.select(F.col(doc_id).alias("doc_id"), predict(F.col(text), model).alias("got"))
    return got.select("doc_id", held_out("doc_id").alias("held_out"), F.col("got.lang").alias("lang_pred"), "got.score")


def keep_known(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> DataFrame:
    """The rows of ``docs`` whose language is known (not ``und``), as they are."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, doc_id, text, lang))
    name = fresh(docs, "lang")
    return docs.withColumn(name, predict(F.col(text), model)["lang"]).where(F.col(name) != UNKNOWN).drop(name)
