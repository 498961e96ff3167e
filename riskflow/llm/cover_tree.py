"""Embedding near-duplicates by dual traversal of cover trees.

Vectors of one label (and length) become unit vectors; cosine >= t is then a
distance of at most sqrt(2 - 2 t).  Equal vectors collapse to one class first.

Spark holds the top of the tree: cells around a bounded sample of centres, each
with its covering radius.  Pairs of cells of the same label that the covering
radii cannot rule out are split into blocks of at most about BLOCK vectors; one
task takes one pair of blocks, builds a cover tree of each (nested levels with
halving radii) and walks both at once, pruning node pairs by
``d(centres) > radius + radius + threshold``.  Leaf pairs that remain are
compared exactly, in double precision.

A task returns, per vector, its number of links and the smallest class of its
local component, never the pairs.  How many block pairs remain depends on the
data: vectors without structure in 64 dimensions cannot be told apart by radii,
and then every pair of blocks of a label is visited once.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import graph
from .common import staged

COSINE = 0.98
BLOCK = 2048  # vectors of a block, on average at most
MOST_CENTRES = 2048  # centres, over all labels
LEAF = 32  # vectors under which a node is not divided
SLACK = 1e-9  # for rounding, in pruning only


def usable(vector: np.ndarray | None) -> np.ndarray | None:
    """The vector in double precision, or None where it has no cosine."""
    if vector is None or not len(vector):
        return None
    v = np.asarray(vector, np.float64)
    return v + 0.0 if np.isfinite(v).all() and v.any() else None


def class_key(vector: Column) -> Column:
    """Digest of the vector's components; null where it takes no part (null,
    zero, or with null or non-finite components)."""

    @F.arrow_udf("string")
    def keyed(vectors: pa.Array) -> pa.Array:
        out = []
        for x in vectors:
            v = x.as_py()
            v = None if v is None or None in v else usable(v)
            out.append(None if v is None else hashlib.md5(v.tobytes()).hexdigest())
        return pa.array(out, pa.string())

    return keyed(vector)


def unit(vectors) -> np.ndarray:
    v = np.stack([np.asarray(x, np.float64) for x in vectors])
    v = v / np.abs(v).max(axis=1, keepdims=True)  # no overflow in the square
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def reach(cosine: float) -> float:
    return math.sqrt(max(0.0, 2 - 2 * cosine))


class CoverTree:
    """Nodes as arrays: centre, covering radius, children or members."""

    def __init__(self, points: np.ndarray):
        self.points = points
        self.centre: list[int] = []
        self.radius: list[float] = []
        self.children: list[np.ndarray | None] = []
        self.members: list[np.ndarray] = []
        self.root = self._node(0, np.arange(len(points)), 2.0)

    def _node(self, centre: int, members: np.ndarray, level: float) -> int:
        at = len(self.centre)
        near = self.points[members] @ self.points[centre]
        self.centre.append(centre)
        self.radius.append(math.sqrt(max(0.0, 2 - 2 * float(near.min()))))
        self.members.append(members)
        self.children.append(None)
        if len(members) > LEAF and self.radius[at] > SLACK:
            while level > self.radius[at]:  # skip levels that would have one child
                level /= 2
            self.children[at] = np.array([self._node(c, m, level / 2) for c, m in self._net(members, level / 2)])
        return at

    def _net(self, members: np.ndarray, radius: float):
        """Centres more than ``radius`` apart, each with the members it covers."""
        p = self.points[members]
        covered = p @ p.T >= 1 - radius * radius / 2
        left = np.ones(len(members), bool)
        for i in range(len(members)):
            if left[i]:
                mine = covered[i] & left
                mine[i] = True
                left &= ~mine
                yield int(members[i]), members[mine]


def close_pairs(a: CoverTree, b: CoverTree, distance: float):
    """Yields (members of a, members of b) of node pairs that pruning leaves,
    down to leaves.  For one tree with itself each pair of nodes comes once, and
    a leaf with itself."""
    same = a is b
    todo = [(np.array([a.root]), np.array([b.root]))]
    while todo:
        x, y = todo.pop()
        own = same and len(x) == len(y) and bool((x == y).all())
        near = a.points[[a.centre[i] for i in x]] @ b.points[[b.centre[i] for i in y]].T
        gap = np.sqrt(np.maximum(0.0, 2 - 2 * near))
        bound = np.array([a.radius[i] for i in x])[:, None] + np.array([b.radius[i] for i in y]) + distance + SLACK
        keep = gap <= bound
        if own:
            keep = np.triu(keep)
        # leaves of one parent against one node are taken together
        for i in np.flatnonzero(keep.any(axis=1)):
            kids_i, with_i = a.children[x[i]], y[keep[i]]
            leaves = []
            for j in with_i:
                kids_j = b.children[j]
                if kids_i is None and kids_j is None:
                    if same and x[i] == j:
                        yield a.members[j], a.members[j]
                    else:
                        leaves.append(b.members[j])
                elif same and x[i] == j:
                    todo.append((kids_i, kids_i))
                else:
                    todo.append((kids_i if kids_i is not None else x[i : i + 1], kids_j if kids_j is not None else np.array([j])))
            if leaves:
                yield a.members[x[i]], np.concatenate(leaves)


def _components(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Smallest index that each of ``n`` nodes reaches by the edges."""
    low = np.arange(n)
    while True:
        least = np.minimum(low[left], low[right])
        new = low.copy()
        np.minimum.at(new, left, least)
        np.minimum.at(new, right, least)
        new = new[new]
        if (new == low).all():
            return low
        low = new


def _link_blocks(cosine: float):
    distance = reach(cosine)

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        one = bool(rows.own.iloc[0])
        rows = rows.sort_values(["side", "key"], kind="stable").reset_index(drop=True)
        sides = [rows.index[rows.side == s].to_numpy() for s in (0, 1)]
        if one:
            sides[1] = sides[0]
        links, weight = np.zeros(len(rows), np.int64), rows.n.to_numpy()
        edges: list[np.ndarray] = []
        if all(map(len, sides)):
            points = unit(rows.embedding)
            a = CoverTree(points[sides[0]])
            b = a if one else CoverTree(points[sides[1]])
            for x, y in close_pairs(a, b, distance):
                i, j = sides[0][x], sides[1][y]
                linked = points[i] @ points[j].T >= cosine
                if one and np.array_equal(x, y):
                    linked &= ~np.eye(len(x), dtype=bool)
                    mirrored = False
                else:
                    mirrored = True
                if linked.any():
                    links[i] += linked @ weight[j]
                    if mirrored:
                        links[j] += weight[i] @ linked
                    p, q = np.nonzero(linked)
                    edges.append(np.stack([i[p], j[q]]).astype(np.int32))
                    if sum(e.shape[1] for e in edges) > 1 << 20:  # keep a forest, not all pairs
                        edges = [_forest(len(rows), edges)]
        touched = np.flatnonzero(links)
        root = _components(len(rows), *_forest(len(rows), edges)) if edges else np.arange(len(rows))
        key = rows.key.to_numpy()
        return pd.DataFrame({"key": key[touched], "links": links[touched], "root": key[root[touched]]})

    return run


def _forest(n: int, edges: list[np.ndarray]) -> np.ndarray:
    both = np.concatenate(edges, axis=1)
    low = _components(n, both[0], both[1])
    moved = np.flatnonzero(low != np.arange(n))
    return np.stack([moved, low[moved]]).astype(np.int32)


def _cells(classes: DataFrame, n_classes: int, distance: float):
    """``classes`` with a cell, and the pairs of cells that may hold links."""
    spark = classes.sparkSession
    wanted = min(MOST_CENTRES, math.ceil(n_classes / BLOCK))
    picked = classes.orderBy("key").limit(wanted).select("space", "embedding").collect()  # bounded by MOST_CENTRES
    by_space: dict[str, list[int]] = {}
    for i, r in enumerate(picked):
        by_space.setdefault(r.space, []).append(i)
    shared = spark.sparkContext.broadcast(
        {s: (np.array(at), unit([picked[i].embedding for i in at])) for s, at in by_space.items()}
    )

    @F.arrow_udf("struct<cell: int, away: double>")
    def nearest(spaces: pa.Array, vectors: pa.Array) -> pa.Array:
        cell, away = np.full(len(spaces), -1, np.int32), np.full(len(spaces), 2.0)
        space = np.array(spaces.to_pylist(), object)
        for s in set(space):
            if s in shared.value:
                at, centres = shared.value[s]
                mine = np.flatnonzero(space == s)
                cos = unit(vectors.take(pa.array(mine)).to_pylist()) @ centres.T
                best = cos.argmax(axis=1)
                cell[mine] = at[best]
                away[mine] = np.sqrt(np.maximum(0.0, 2 - 2 * cos[np.arange(len(mine)), best]))
        return pa.StructArray.from_arrays([pa.array(cell), pa.array(away)], names=["cell", "away"])

    @F.arrow_udf("double")
    def apart(spaces: pa.Array, a: pa.Array, b: pa.Array) -> pa.Array:
        out = np.zeros(len(spaces))
        for i, (s, x, y) in enumerate(zip(spaces.to_pylist(), a.to_pylist(), b.to_pylist())):
            if x >= 0 and y >= 0:
                at, centres = shared.value[s]
                u, v = centres[np.searchsorted(at, x)], centres[np.searchsorted(at, y)]
                out[i] = math.sqrt(max(0.0, 2 - 2 * float(u @ v)))
        return pa.array(out)

    near = nearest(F.col("space"), F.col("embedding"))
    placed = staged(classes.select("*", near.alias("near")).select(*classes.columns, "near.cell", "near.away"), "cells")
    cells = placed.groupBy("space", "cell").agg(F.count(F.lit(1)).alias("size"), F.max("away").alias("radius"))
    cells = cells.withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    # at most MOST_CENTRES cells and one more per label without a centre
    a = cells.select("space", *(F.col(c).alias(f"a_{c}") for c in ("cell", "radius", "blocks")))
    b = cells.select("space", *(F.col(c).alias(f"b_{c}") for c in ("cell", "radius", "blocks")))
    pairs = a.join(b, "space").where("a_cell <= b_cell").withColumn("gap", apart(F.col("space"), F.col("a_cell"), F.col("b_cell")))
    pairs = pairs.where(F.col("gap") <= F.col("a_radius") + F.col("b_radius") + distance + SLACK)
    pairs = pairs.withColumn("a_block", F.explode(F.sequence(F.lit(0), F.col("a_blocks") - 1)))
    pairs = pairs.withColumn("b_block", F.explode(F.sequence(F.lit(0), F.col("b_blocks") - 1)))
    pairs = pairs.where("a_cell < b_cell or a_block <= b_block")
    own = (F.col("a_cell") == F.col("b_cell")) & (F.col("a_block") == F.col("b_block"))
    pairs = pairs.select("space", "a_cell", "a_block", "b_cell", "b_block", own.alias("own"))
    blocks = placed.join(cells.select("space", "cell", "blocks"), ["space", "cell"])
    blocks = blocks.withColumn("block", F.pmod(F.xxhash64("key"), F.col("blocks")).cast("int")).drop("away", "blocks", "low")
    return blocks, staged(pairs, "block-pairs")


def links(classes: DataFrame, cosine: float = COSINE) -> DataFrame:
    """(key, links, root) rows of ``classes`` (key, space, embedding, n): partial
    link counts, weighted by n, and a class of the same component.  Classes
    without a link have no row."""
    n_classes = classes.count()
    blocks, pairs = _cells(classes, n_classes, reach(cosine))
    at = ["space", "a_cell", "a_block", "b_cell", "b_block", "own"]
    left = pairs.withColumn("side", F.lit(0)).withColumns({"cell": F.col("a_cell"), "block": F.col("a_block")})
    right = pairs.where("not own").withColumn("side", F.lit(1)).withColumns({"cell": F.col("b_cell"), "block": F.col("b_block")})
    dealt = blocks.join(left.unionByName(right), ["space", "cell", "block"])
    dealt = dealt.select(*at, "side", "key", "n", "embedding")
    return dealt.groupBy(*at).applyInPandas(_link_blocks(cosine), "key string, links long, root string")


def near_duplicates(
    vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", cosine: float = COSINE
) -> DataFrame:
    """One row per input row: vec_id, n_links (other rows linked directly),
    component_id (smallest vec_id reachable by links, itself included), kept
    (vec_id = component_id).

    Rows link when their labels are equal and not null, their vectors have the
    same length and their cosine is at least ``cosine``.  Null, zero and empty
    vectors, and those with null or non-finite components, link with nothing, as
    do rows without vec_id, which are never kept.  Rows that repeat a vector
    link with each other like any others.  An empty table gives an empty result.
    """
    rows = vectors.select(F.col(vec_id).alias("vec_id"), F.col(label).cast("string").alias("label"), F.col(embedding).alias("embedding"))
    valid = F.when(F.col("vec_id").isNotNull() & F.col("label").isNotNull(), class_key(F.col("embedding")))
    space = F.concat_ws(":", F.size("embedding").cast("string"), F.col("label"))
    rows = rows.withColumn("valid", valid).withColumn("space", F.when(F.col("valid").isNotNull(), space))
    rows = staged(rows.withColumn("key", F.when(F.col("valid").isNotNull(), F.md5(F.concat_ws(":", "space", "valid")))).drop("valid", "label"), "vectors")
    classes = staged(
        rows.where("key is not null").groupBy("key")
        .agg(F.min("vec_id").alias("low"), F.count(F.lit(1)).alias("n"), F.first("space").alias("space"), F.first("embedding").alias("embedding")),
        "classes",
    )
    found = staged(links(classes, cosine), "links")
    roots = graph.components(found.select("key", "root"), "key", "root")
    named = classes.select("key", "low", "n").join(found.groupBy("key").agg(F.sum("links").alias("links")), "key", "left")
    named = named.join(roots.withColumnRenamed("node", "key"), "key", "left").withColumn("root", F.coalesce("root", "key"))
    first = named.groupBy("root").agg(F.min("low").alias("component_id"))
    named = staged(named.join(first, "root").select("key", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id"), "named")
    out = rows.select("vec_id", "key").join(named, "key", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("component_id", "vec_id").alias("component_id"),
    ).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


#: The same rows in DuckDB SQL, for unique, non-null vec_ids.
ORACLE = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= {COSINE}),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
least AS (SELECT x, least(x, min(y)) AS c FROM reach GROUP BY x),
degree AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, coalesce(c, vec_id) AS component_id, coalesce(c, vec_id) = vec_id AS kept
FROM embeddings LEFT JOIN least ON least.x = vec_id LEFT JOIN degree ON degree.x = vec_id
"""
