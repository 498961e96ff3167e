"""Approximate nearest neighbours on shifted space-filling curves.

Every vector is projected to a few dimensions in several ways (random rotation
and shift), and each projection is ordered along a Hilbert curve.  An ordering
is cut into blocks at the quantiles of a bounded sample of keys (a range
partition), and a query is compared with the blocks that its window of
neighbouring keys meets, in every ordering.  The finds merge and are ranked by
the exact inner product of the original vectors.

The width of the window is fitted, not guessed: for a bounded sample of queries
the true neighbours are found against all rows in blocks, and the window is the
``RECALL`` quantile of how far, in the nearest ordering, a true neighbour's key
lies from the query's.  Structured vectors get narrow windows; vectors without
structure get wide ones, up to the whole ordering, which is exact.

Equal vectors are searched once: a class holds its smallest ids only, as many
as an answer can name, which loses nothing.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged
from .cover_tree import class_key

K = 20
ORDERINGS = 4
DIMENSIONS, BITS = 8, 7  # of a projection; 56 bits of key
RECALL = 0.96  # of the sampled true neighbours lie in the window
SAMPLE_KEYS = 8192  # vectors whose keys give the quantiles
SAMPLE_QUERIES = 96  # queries whose true neighbours give the window
BLOCK_ROWS = 2048  # least rows of a block
SPLIT_ROWS = 16384  # vectors, or queries, of one task


def hilbert_keys(cells: np.ndarray, bits: int) -> np.ndarray:
    """Position on the Hilbert curve of each row of cell numbers, by Gray-code
    exchange of the axes (Skilling, 2004)."""
    x = cells.astype(np.uint64).T.copy()
    n = len(x)
    one = np.uint64(1)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        p = q - one
        for i in range(n):
            high = (x[i] & q) != 0
            x[0] = np.where(high, x[0] ^ p, x[0])
            t = np.where(high, 0, (x[0] ^ x[i]) & p).astype(np.uint64)
            x[0] ^= t
            x[i] ^= t
        q >>= one
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t = np.zeros(x.shape[1], np.uint64)
    q = np.uint64(1 << (bits - 1))
    while q > one:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - one), t)
        q >>= one
    x ^= t
    key = np.zeros(x.shape[1], np.uint64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << one) | ((x[i] >> np.uint64(b)) & one)
    return key.astype(np.int64)


class Curves:
    """The fitted orderings of vectors of one length."""

    def __init__(self, sample: np.ndarray, orderings: int = ORDERINGS, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.axes, self.low, self.step, self.sorted = [], [], [], []
        width = sample.shape[1]
        for _ in range(orderings):
            turn = np.linalg.qr(rng.standard_normal((width, width)))[0][:, : min(DIMENSIONS, width)]
            at = sample @ turn
            low, high = at.min(axis=0), at.max(axis=0)
            span = np.maximum(high - low, 1e-12)
            self.axes.append(turn)
            self.low.append(low - rng.random(len(low)) * 0.25 * span)  # the shift
            self.step.append(1.25 * span / (1 << BITS))
        for r in range(orderings):
            self.sorted.append(np.sort(self.keys(sample, r)))

    def keys(self, vectors: np.ndarray, r: int) -> np.ndarray:
        cell = np.floor((vectors @ self.axes[r] - self.low[r]) / self.step[r])
        return hilbert_keys(np.clip(cell, 0, (1 << BITS) - 1), BITS)

    def places(self, vectors: np.ndarray) -> np.ndarray:
        """Row per ordering: the share of the sample's keys before each vector."""
        keys = [self.keys(vectors, r) for r in range(len(self.axes))]
        return np.stack([
            (np.searchsorted(s, k, side="left") + np.searchsorted(s, k, side="right")) / (2 * len(s))
            for s, k in zip(self.sorted, keys)
        ])


def _matrix(column) -> np.ndarray:
    return np.stack([np.asarray(x, np.float64) for x in column])


def _blocks(place: np.ndarray, n: int) -> np.ndarray:
    return np.minimum((place * n).astype(np.int64), n - 1)


def top(queries: np.ndarray, vectors: np.ndarray, ids: list[np.ndarray], k: int):
    """Per query (ids, scores) of the ``k`` best rows, ties to smaller ids.  A
    vector stands for all its ids.  Scores are sums in double precision whose
    order does not depend on the block."""
    for at in range(0, len(queries), 256):
        part = queries[at : at + 256]
        near = part @ vectors.T
        for q, row in zip(part, near):
            if len(row) > k:
                least = np.partition(row, len(row) - k)[len(row) - k]
                best = np.flatnonzero(row >= least - 1e-9 * max(1.0, abs(least)))
            else:
                best = np.arange(len(row))
            exact = (vectors[best] * q).sum(axis=1)
            size = [len(ids[i]) for i in best]
            who, score = np.concatenate([ids[i] for i in best]), np.repeat(exact, size)
            order = np.lexsort((who, -score))[:k]
            yield who[order], score[order]


def _search_group(k: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        q, c = rows[rows.ids.isna()], rows[rows.ids.notna()]
        if not len(q) or not len(c):
            return pd.DataFrame({"query": [], "found": [], "scores": []})
        got = list(top(_matrix(q.embedding), _matrix(c.embedding), [np.asarray(x) for x in c.ids], k))
        return pd.DataFrame({"query": q.key.to_numpy(), "found": [g[0] for g in got], "scores": [g[1] for g in got]})

    return run


def _true_neighbours(classes: DataFrame, queries: pd.DataFrame, k: int) -> pd.DataFrame:
    """(query number, embedding) of the sampled queries' nearest classes, found
    against all rows in blocks: each block keeps its best k per query."""
    shared = classes.sparkSession.sparkContext.broadcast(_matrix(queries.embedding))

    def best(batches):
        for rows in batches:
            if len(rows):
                vectors = _matrix(rows.embedding)
                near = shared.value @ vectors.T
                cut = np.argsort(-near, axis=1, kind="stable")[:, : k + 1]
                q = np.repeat(np.arange(len(near)), cut.shape[1])
                yield pd.DataFrame({"q": q, "score": near[q, cut.ravel()], "embedding": rows.embedding.to_numpy()[cut.ravel()]})

    found = classes.select("embedding").mapInPandas(best, "q long, score double, embedding array<double>")
    nth = F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score")))
    return found.withColumn("nth", nth).where(F.col("nth") <= k + 1).select("q", "nth", "embedding").toPandas()


def window_share(curves: Curves, queries: pd.DataFrame, truth: pd.DataFrame, recall: float) -> float:
    """The half width of the window, as a share of an ordering."""
    here = curves.places(_matrix(queries.embedding))
    there = curves.places(_matrix(truth.embedding))
    away = np.abs(here[:, truth.q.to_numpy()] - there).min(axis=0)
    away = away[truth.nth.to_numpy() > 1]  # the first is the query itself
    return float(np.quantile(away, recall)) if len(away) else 1.0


def _deal(classes: DataFrame, curves, n_blocks: int, window: float, splits: int, query_splits: int):
    """Candidates and queries with the task that meets them: (ordering, block,
    split of the block, split of its queries)."""

    @F.arrow_udf("array<int>")
    def blocks_of(vectors: pa.Array) -> pa.Array:
        place = curves.value.places(_matrix(vectors.to_pylist())) if len(vectors) else np.zeros((1, 0))
        return pa.array(_blocks(place, n_blocks).T.astype(np.int32).tolist(), pa.list_(pa.int32()))

    @F.arrow_udf("array<struct<ordering: int, block: int>>")
    def window_of(vectors: pa.Array) -> pa.Array:
        place = curves.value.places(_matrix(vectors.to_pylist())) if len(vectors) else np.zeros((1, 0))
        low, high = _blocks(np.maximum(place - window, 0), n_blocks), _blocks(np.minimum(place + window, 1), n_blocks)
        rows = [
            [{"ordering": r, "block": b} for r in range(len(place)) for b in range(low[r, i], high[r, i] + 1)]
            for i in range(place.shape[1])
        ]
        return pa.array(rows, pa.list_(pa.struct([("ordering", pa.int32()), ("block", pa.int32())])))

    part = lambda n, salt: F.pmod(F.xxhash64("key", F.lit(salt)), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    found = classes.select("key", "embedding", "ids", F.posexplode(blocks_of(F.col("embedding"))).alias("ordering", "block"))
    candidates = found.withColumn("split", part(splits, 1)).withColumn("query_split", every(query_splits))
    asked = classes.where("asked").select("key", "embedding", F.explode(window_of(F.col("embedding"))).alias("w"))
    asked = asked.select("key", "embedding", F.lit(None).cast("array<long>").alias("ids"), "w.ordering", "w.block")
    queries = asked.withColumn("split", every(splits)).withColumn("query_split", part(query_splits, 2))
    return candidates.unionByName(queries)


def search(vectors: DataFrame, asked: Column, vec_id: str = "vec_id", embedding: str = "embedding", k: int = K,
           recall: float = RECALL) -> DataFrame:
    """The ``k`` nearest rows by inner product of every row where ``asked`` (a
    condition on ``vec_id``) holds, itself left out: query_id, rank from 1,
    vec_id, score; all the others where there are fewer.

    Rows without vec_id, and null, zero or empty vectors or those with null or
    non-finite components, take no part.  Vectors of different lengths are
    searched apart.  Ties go to the smaller vec_id.  A repeated vec_id is one
    candidate per vector and never its own neighbour.  An empty table gives an
    empty result."""
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(embedding).cast("array<double>").alias("embedding"))
    rows = rows.select("vec_id", "embedding", asked.alias("asked")).where("vec_id is not null").distinct()
    rows = staged(rows.withColumn("key", class_key(F.col("embedding"))).where("key is not null"), "vectors")
    nth = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    least = rows.select("key", "vec_id", nth.alias("nth")).where(F.col("nth") <= k + 1)  # no answer names more of them
    least = least.groupBy("key").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    kinds = rows.groupBy("key").agg(F.max("asked").alias("asked"), F.first("embedding").alias("embedding"))
    classes = staged(kinds.join(least, "key").withColumn("width", F.size("embedding")), "classes")
    found = None
    for r in classes.groupBy("width").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("asked").cast("long")).alias("q")).orderBy("width").collect():
        if r.q:
            got = _search_width(classes.where(F.col("width") == r.width), r.n, r.q, k, recall)
            found = got if found is None else found.unionByName(got)
    empty = rows.sparkSession.createDataFrame([], "query string, vec_id long, score double")
    found = empty if found is None else found
    best = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "vec_id"))
    found = found.distinct().withColumn("n", best).where(F.col("n") <= k + 1).drop("n")
    queries = rows.where("asked").select(F.col("key").alias("query"), F.col("vec_id").alias("query_id"))
    pairs = queries.join(found, "query").where("query_id <> vec_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _search_width(classes: DataFrame, n: int, n_asked: int, k: int, recall: float) -> DataFrame:
    """(query, vec_id, score) finds among classes of vectors of one length."""
    sample = classes.orderBy("key").limit(SAMPLE_KEYS).select("embedding").toPandas()  # bounded
    curves = Curves(_matrix(sample.embedding))
    queries = classes.where("asked").orderBy("key").limit(SAMPLE_QUERIES).select("embedding").toPandas()  # bounded
    window = window_share(curves, queries, _true_neighbours(classes, queries, k), recall)
    # blocks no finer than the window, so a query meets a few blocks whatever the size
    n_blocks = max(1, min(n // BLOCK_ROWS, int(1 / max(window, 1 / SAMPLE_KEYS))))
    splits = math.ceil(n / n_blocks / SPLIT_ROWS)
    query_splits = math.ceil(n_asked * min(1.0, 2 * window + 1 / n_blocks) / SPLIT_ROWS)
    shared = classes.sparkSession.sparkContext.broadcast(curves)
    dealt = _deal(classes, shared, n_blocks, window, splits, query_splits)
    # one more than asked for, as a query may find itself
    got = dealt.groupBy("ordering", "block", "split", "query_split").applyInPandas(
        _search_group(k + 1), "query string, found array<long>, scores array<double>"
    )
    zipped = F.explode(F.arrays_zip("found", "scores")).alias("f")
    return got.select("query", zipped).select("query", F.col("f.found").alias("vec_id"), F.col("f.scores").alias("score"))
