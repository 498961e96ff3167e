"""Ranked lexical search by exact inner products on sparse ball trees.

A document is the sparse vector of its terms' saturated frequencies (whole
numbers), an item the vector of its terms' weights; the score is their inner
product.  Documents are vectorised once, over the terms that items name, and
held as a table.  Every task then takes its documents block by block, builds a
ball tree of each block (balanced two-pivot splits; a node knows its members'
centroid and the radius around it) and searches it for every item, best-first:

    score <= <item, centroid> + |item| * radius

holds for all members of a node, so a subtree goes unread when that bound,
rounded up, is below the item's ``k``-th best score so far, which carries over
from block to block.  Leaves are scored exactly, in 64-bit integers.  As no
weight is negative, the radius need only cover what members have beyond the
centroid; and as an item names few terms, the same bound taken apart by groups of
axes (a centroid and a radius each) is often the smaller one; the lesser counts.

The bound holds in any scaling of the axes (documents times ``a``, items divided
by it); ``a`` balances how far documents spread along a term against the weight
items give it, which keeps the product of the two norms small.

Items are taken in blocks of at most ``BLOCK_TERMS`` terms (or one item, if it
has more); what is broadcast is one such block.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..operators.running import running_total
from .common import staged

K = 50
#: Fixed values of the score: see ``saturation`` and ``lengths``.
ONE, PER_TF, PER_LENGTH, LENGTH_SHARE = 1_000_000_000, 1000, 20, 50
BLOCK_TERMS = 1 << 18  # of the items searched together
BLOCK_ROWS, BLOCK_VALUES = 8192, 1 << 20  # of the documents in one tree
LEAF_ROWS = 48
AXIS_GROUPS = 1024  # of the terms, each with radii of its own
PIECE_BYTES = 4 << 20  # of a text whose words are held at once

#: The signs of terms, as UTF-8 bytes after lower-casing A-Z; on
#: characters [^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+.
_TERMS = re.compile(rb"[0-9a-z\x80-\xff]+")
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def _words(text: bytes | None) -> Iterator[list[bytes]]:
    """The terms of a text, in pieces cut between terms."""
    text, at = (text or b"").translate(_LOWER), 0
    while at < len(text):
        end = at + PIECE_BYTES
        inside = _TERMS.match(text, end) if end < len(text) else None
        end = inside.end() if inside else end
        yield _TERMS.findall(text, at, min(end, len(text)))
        at = end


def item_terms(items: DataFrame, item_id: str, text: str) -> DataFrame:
    """(item_id, terms, block): the distinct terms of every item.  Rows that
    share an id (or have none) are one item with the terms of all."""

    @F.arrow_udf("array<binary>")
    def terms(texts: pa.Array) -> pa.Array:
        found = [sorted({w for words in _words(x) for w in words}) for x in texts.cast(pa.large_binary()).to_pylist()]
        return pa.array(found, pa.list_(pa.binary()))

    rows = items.select(F.col(item_id).alias("item_id"), F.explode(terms(F.col(text).cast("string"))).alias("term"))
    rows = rows.distinct().groupBy("item_id").agg(F.sort_array(F.collect_list("term")).alias("terms"))
    sizes = running_total(rows, [F.asc_nulls_first("item_id")], value=F.size("terms"), out="until")
    return staged(sizes.withColumn("block", F.floor((F.col("until") - 1) / BLOCK_TERMS)).drop("until"), "items")


def vectorise(docs: DataFrame, doc_id: str, text: str, shared) -> DataFrame:
    """(doc_id, n, terms, tf) of every document: its number of terms, and which
    of the broadcast vocabulary it holds how often."""

    def run(batches):
        vocabulary = shared.value
        for batch in batches:
            n, terms, tf = [], [], []
            for x in batch.column(1).cast(pa.large_binary()).to_pylist():
                size, found = 0, Counter()
                for words in _words(x):
                    size += len(words)
                    count = Counter(words)
                    for w in count.keys() & vocabulary.keys():
                        found[vocabulary[w]] += count[w]
                held = sorted(found.items())
                n.append(size), terms.append([t for t, _ in held]), tf.append([c for _, c in held])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n, pa.int64()), pa.array(terms, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int64()))],
                names=["doc_id", "n", "terms", "tf"],
            )

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = T.StructType([rows.schema["doc_id"]]).add("n", "long").add("terms", T.ArrayType(T.IntegerType())).add("tf", T.ArrayType(T.LongType()))
    return rows.mapInArrow(run, kind)


def lengths(n: np.ndarray, documents: int, terms: int) -> np.ndarray:
    """Each document's length part of the score (m), by whole numbers."""
    if len(n) and LENGTH_SHARE * int(n.max()) * documents >= 1 << 62:  # beyond 64 bits on the way: Python's integers
        share = np.array([LENGTH_SHARE * int(x) * documents // terms for x in n], np.int64)
    else:
        share = LENGTH_SHARE * n * documents // terms
    return 100 - LENGTH_SHARE + share


def saturation(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return ONE * tf // (PER_TF * tf + PER_LENGTH * m)


def weight(df: np.ndarray, documents: int) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Query:
    """The items of a block, with their terms' weights and the axes' scaling."""

    def __init__(self, items: list[np.ndarray], weights: np.ndarray, df: np.ndarray, documents: int, k: int):
        self.k, self.weights = k, weights
        self.items = [t[(weights[t] > 0) & (df[t] > 0)] for t in items]  # others add nothing to any score
        named = np.bincount(np.concatenate([*self.items, np.empty(0, np.int64)]).astype(np.int64), minlength=len(weights))
        share = np.clip(df / max(1, documents), 1e-12, 1 - 1e-6)
        spread = np.sqrt(share * (1 - share))
        self.axes = np.sqrt(np.maximum(weights, 1) * np.sqrt(np.maximum(named, 1)) / spread)
        self.used = named > 0


def axis_groups(terms: np.ndarray, n_terms: int) -> np.ndarray:
    """The group of axes of each term; neighbouring terms share one."""
    return terms * AXIS_GROUPS // n_terms if n_terms > AXIS_GROUPS else terms


class BallTree:
    """Ball tree of sparse rows (CSR: starts, terms, whole values)."""

    def __init__(self, starts: np.ndarray, terms: np.ndarray, values: np.ndarray, axes: np.ndarray, leaf: int = LEAF_ROWS):
        self.leaf, self.axes = leaf, axes
        scaled = values * axes[terms]
        n = len(starts) - 1
        self.norm = np.bincount(np.repeat(np.arange(n), np.diff(starts)), scaled * scaled, minlength=n)
        self.low, self.high, self.radius, self.left = [], [], [], []
        self.group_radius: list[np.ndarray] = []
        self.n_groups = min(AXIS_GROUPS, len(axes))
        self.centres: list[tuple[np.ndarray, np.ndarray]] = []
        order = np.arange(n)
        csr = (starts, terms, scaled)
        self._grow(order, 0, n, csr)
        self.low, self.high, self.left = np.array(self.low), np.array(self.high), np.array(self.left)
        self.radius, self.group_radius = np.array(self.radius), np.stack(self.group_radius)
        # rows in tree order, so that a leaf is one stretch
        self.order = order
        at, self.starts = _gather(starts, order)
        self.terms, self.values = terms[at], values[at]
        # centroids by term: which nodes hold it, and how much
        size = [len(t) for t, _ in self.centres]
        by = np.concatenate([t for t, _ in self.centres])
        sort = np.argsort(by, kind="stable")
        self.by_node = np.repeat(np.arange(len(size)), size)[sort]
        self.by_value = np.concatenate([v for _, v in self.centres])[sort]
        self.by_start = np.searchsorted(by[sort], np.arange(len(axes) + 1))
        self.centres = []

    def _grow(self, order: np.ndarray, low: int, high: int, csr) -> int:
        starts, terms, scaled = csr
        node = len(self.low)
        rows = order[low:high]
        at, inner = _gather(starts, rows)
        t, v = terms[at], scaled[at]
        whose = np.repeat(np.arange(len(rows)), np.diff(inner))
        kinds, place = np.unique(t, return_inverse=True)
        centre = np.bincount(place, v, minlength=len(kinds)) / len(rows)
        near = np.bincount(whose, v * centre[place], minlength=len(rows))
        size = float(centre @ centre)
        away = self.norm[rows] - 2 * near + size
        self.low.append(low), self.high.append(high), self.left.append(-1)
        beyond = np.maximum(v - centre[place], 0) ** 2
        self.radius.append(math.sqrt(float(np.bincount(whose, beyond, minlength=len(rows)).max())))
        groups = np.zeros(self.n_groups)
        if len(t):  # a row's terms are in order, so each of its groups is one run
            group = axis_groups(t, len(self.axes))
            run = np.flatnonzero(np.r_[True, (group[1:] != group[:-1]) | (whose[1:] != whose[:-1])])
            np.maximum.at(groups, group[run], np.add.reduceat(beyond, run))
        self.group_radius.append(np.sqrt(groups))
        self.centres.append((kinds, centre))
        if len(rows) > self.leaf:
            def to(row: int) -> np.ndarray:
                dense = np.zeros(len(kinds))
                mine = slice(inner[row], inner[row + 1])
                dense[place[mine]] = v[mine]
                return self.norm[rows] - 2 * np.bincount(whose, v * dense[place], minlength=len(rows)) + self.norm[rows[row]]

            first = to(int(np.argmax(away)))  # the two pivots: far from the centre, and far from that one
            lean = first - to(int(np.argmax(first)))
            half = len(rows) // 2
            order[low:high] = rows[np.argpartition(lean, half)]
            self._grow(order, low, low + half, csr)  # the left child is the next node
            self.left[node] = self._grow(order, low + half, high, csr)
        return node

    def bounds(self, terms: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Of every node: no member scores higher.  Rounded up."""
        item = weights[terms] / self.axes[terms]
        spans = [np.arange(self.by_start[t], self.by_start[t + 1]) for t in terms]
        at = np.concatenate(spans)
        scale = np.repeat(item, [len(s) for s in spans])
        centre = np.bincount(self.by_node[at], self.by_value[at] * scale, minlength=len(self.low))
        groups, of = np.unique(axis_groups(terms, len(self.axes)), return_inverse=True)
        norms = np.sqrt(np.bincount(of, item * item))
        away = np.minimum(self.radius * math.sqrt(float(item @ item)), self.group_radius[:, groups] @ norms)
        # rounding is far below a billionth of the sums
        return (centre + away) * (1 + 1e-9) + 1

    def search(self, bounds: np.ndarray, dense: np.ndarray, least: int, k: int) -> tuple[np.ndarray, np.ndarray, int]:
        """(rows, scores, leaves read): every row that may be among the ``k``
        best, given that ``least`` is the score to reach."""
        open_nodes = [(-bounds[0], 0)]
        best: list[int] = []  # heap of the k best scores of this tree
        rows, scores, read = [], [], 0
        while open_nodes:
            bound, node = heapq.heappop(open_nodes)
            if -bound < least:
                break  # best-first: all others are below too
            if self.left[node] < 0:
                read += 1
                low, high = self.low[node], self.high[node]
                mine = slice(self.starts[low], self.starts[high])
                got = np.add.reduceat(np.append(dense[self.terms[mine]] * self.values[mine], 0), self.starts[low:high] - self.starts[low])
                hit = np.flatnonzero(got >= least)
                if len(hit):
                    rows.append(self.order[low:high][hit]), scores.append(got[hit])
                    for s in got[hit].tolist():
                        heapq.heappush(best, s) if len(best) < k else heapq.heappushpop(best, s)
                    if len(best) == k:
                        least = max(least, best[0])
            else:
                for child in (node + 1, self.left[node]):
                    if bounds[child] >= least:
                        heapq.heappush(open_nodes, (max(bound, -bounds[child]), int(child)))
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), read
        rows, scores = np.concatenate(rows), np.concatenate(scores)
        keep = scores >= least
        return rows[keep], scores[keep], read


def _gather(starts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where the values of ``rows`` lie, end to end, and their own starts."""
    size = starts[rows + 1] - starts[rows]
    own = np.r_[0, np.cumsum(size)]
    return np.arange(own[-1]) + np.repeat(starts[rows] - own[:-1], size), own


def _blocks(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """Rows of a batch in trees of bounded size (a single row can be larger)."""
    ends = np.cumsum(np.asarray(batch.column("terms").value_lengths().fill_null(0)))
    at = 0
    while at < batch.num_rows:
        done = ends[at - 1] if at else 0
        end = min(at + BLOCK_ROWS, int(np.searchsorted(ends, done + BLOCK_VALUES, side="right")))
        end = min(max(end, at + 1), batch.num_rows)
        yield batch.slice(at, end - at)
        at = end


def _tree(block: pa.RecordBatch, query: Query, documents: int, total: int):
    """(ids, tree) of the rows that hold any term that counts."""
    lists = block.column("terms")
    starts = np.r_[0, np.cumsum(np.asarray(lists.value_lengths()))].astype(np.int64)
    terms = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    tf = block.column("tf").flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    row = np.repeat(np.arange(block.num_rows), np.diff(starts))
    m = lengths(block.column("n").to_numpy(zero_copy_only=False), documents, total)
    counts = query.used[terms]
    row, terms, values = row[counts], terms[counts], saturation(tf, m[row])[counts]
    some = np.unique(row)
    if not len(some):
        return None, None
    starts = np.r_[np.searchsorted(row, some), len(row)]
    return block.column("doc_id").take(pa.array(some)).to_pylist(), BallTree(starts, terms, values, query.axes)


def _search_task(shared, documents: int, total: int, schema: pa.Schema):
    """Streams a task's documents through trees and returns each item's best."""

    def run(batches):
        query: Query = shared.value
        best: list[list[tuple]] = [[] for _ in query.items]  # (minus score, id is null, id), sorted
        dense = np.zeros(len(query.weights), np.int64)
        for batch in batches:
            for block in _blocks(batch):
                ids, tree = _tree(block, query, documents, total)
                if tree is None:
                    continue
                for q, terms in enumerate(query.items):
                    if not len(terms):
                        continue
                    least = -best[q][-1][0] if len(best[q]) == query.k else 1
                    bounds = tree.bounds(terms, query.weights)
                    if bounds[0] < least:
                        continue
                    dense[terms] = query.weights[terms]
                    rows, scores, _ = tree.search(bounds, dense, least, query.k)
                    dense[terms] = 0
                    new = [(-s, ids[r] is None, ids[r] if ids[r] is not None else 0) for r, s in zip(rows.tolist(), scores.tolist())]
                    if new:
                        best[q] = sorted(best[q] + new)[: query.k]
        for at in range(0, len(best), 256):
            found = [(q, None if x[1] else x[2], -x[0]) for q in range(at, min(at + 256, len(best))) for x in best[q]]
            columns = [pa.array(c, t.type) for c, t in zip(zip(*found), schema)] if found else [pa.array([], t.type) for t in schema]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)

    return run


def _best(found: DataFrame, by: list[str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id")))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def search(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", k: int = K,
) -> DataFrame:
    """The ``k`` best documents of every item with a score above 0 (all, if
    fewer): item_id, rank (int, from 1), doc_id, score; exact.

    Null and empty texts have no terms.  Ties go to the smaller doc_id, a null id
    last; repeated documents are documents of their own.  Rows of ``items`` that
    share an id are one item.  An empty table on either side gives an empty
    result.  Ids need an order; other columns are not read."""
    spark = docs.sparkSession
    wanted = item_terms(items, item_id, item_text)
    kind = T.StructType([
        T.StructField("item_id", items.select(item_id).schema[0].dataType), T.StructField("rank", T.IntegerType()),
        T.StructField("doc_id", docs.select(doc_id).schema[0].dataType), T.StructField("score", T.LongType()),
    ])
    found = None
    blocks = wanted.agg(F.max("block")).first()[0]
    for block in range(0 if blocks is None else int(blocks) + 1):
        held = wanted.where(F.col("block") == block).select("item_id", "terms").collect()  # BLOCK_TERMS terms
        if held:
            got = _search_block(docs, held, kind, doc_id, text, k)
            found = got if found is None else found.unionByName(got)
    return spark.createDataFrame([], kind) if found is None else found


def _search_block(docs: DataFrame, held: list, kind: T.StructType, doc_id: str, text: str, k: int) -> DataFrame:
    spark = docs.sparkSession
    context = spark.sparkContext
    vocabulary = {bytes(t): i for i, t in enumerate(sorted({bytes(t) for r in held for t in r.terms}))}
    vectors = staged(vectorise(docs, doc_id, text, context.broadcast(vocabulary)), "vectors")
    size = vectors.agg(F.count_if(F.col("n") > 0).alias("documents"), F.sum("n").alias("terms")).first()
    if not size.documents:
        return spark.createDataFrame([], kind)
    df = np.zeros(len(vocabulary), np.int64)
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # at most the vocabulary
        df[r.t] = r["count"]
    named = [np.array(sorted(vocabulary[bytes(t)] for t in r.terms), np.int64) for r in held]
    shared = context.broadcast(Query(named, weight(df, size.documents), df, size.documents, k))
    out = T.StructType([T.StructField("item", T.LongType()), kind["doc_id"], kind["score"]])
    some = vectors.where(F.size("terms") > 0)
    found = some.mapInArrow(_search_task(shared, size.documents, size.terms, to_arrow_schema(out)), out)
    # a task has k rows an item at most; merged in two steps, as an item has rows of every task
    part = F.pmod(F.xxhash64("doc_id"), F.lit(64))
    found = _best(found.withColumn("part", part), ["item", "part"], k)
    found = _best(found, ["item"], k)
    names = spark.createDataFrame([(i, r.item_id) for i, r in enumerate(held)], T.StructType([out["item"], kind["item_id"]]))
    return found.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")


_TERM_LIST = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
ORACLE = rf"""
WITH d AS (SELECT doc_id, row_number() OVER () AS row, {_TERM_LIST} AS terms FROM documents),
q AS (SELECT DISTINCT item_id, unnest({_TERM_LIST}) AS term FROM benchmark),
size AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS all_terms FROM d WHERE len(terms) > 0),
tf AS (SELECT row, term, count(*) AS tf FROM (SELECT row, unnest(terms) AS term FROM d) GROUP BY ALL),
w AS (
  SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, size GROUP BY term, docs),
m AS (SELECT row, doc_id, 100 - 50 + (50 * len(terms) * docs) // all_terms AS m FROM d, size),
scored AS (
  SELECT item_id, row, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m)))::BIGINT AS score
  FROM q JOIN tf USING (term) JOIN w USING (term) JOIN m USING (row) GROUP BY ALL),
ranked AS (
  SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
  FROM scored JOIN m USING (row) WHERE score > 0)
SELECT * FROM ranked WHERE rank <= 50
"""
