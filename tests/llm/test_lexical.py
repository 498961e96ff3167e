"""Ranked lexical search on ball trees against scoring every document."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from riskflow.llm import ball_tree, queries
from tools.check_oracles import compare, duck

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return [t.translate({i: i + 32 for i in range(65, 91)}) for t in TERM.findall(text or "")]


def plain(docs, items, k=50):
    held = [(i, Counter(terms(t))) for i, t in docs]
    n_docs, total = sum(bool(c) for _, c in held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, wanted in asked.items():
        found = []
        for i, c in held:
            m = 100 - 50 + 50 * sum(c.values()) * n_docs // total if total else 0
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 20 * m))
                    for t in wanted if c[t])
            if s > 0:
                found.append((-s, i is None, i or 0))
        out += [(item, rank, None if null else i, -s) for rank, (s, null, i) in enumerate(sorted(found)[:k], 1)]
    return sorted(out, key=str)


def table(n, seed=1):
    rng = random.Random(seed)
    words = [f"t{i}" for i in range(200)] + ["The", "THE", "Über", "über", "漢字", "a_b", "x.y"]
    weight = [1 / (i + 1) for i in range(len(words))]
    docs = [(i, rng.choice([" ", "-", "\n"]).join(rng.choices(words, weight, k=rng.randint(0, 40)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "..."), (None, "t5 t6 t7"), (None, "t5 t6 t7"), (7, docs[7][1]), (n + 3, "t150 " * 3000)]
    items = [(i, " ".join(rng.choices(words, k=8))) for i in range(12)] + [(12, None), (13, "..."), (14, "nowhere"), (2, "t9 t10"), (None, "t1 t2")]
    return docs, items


def test_ranks_equal_scoring_every_document(spark, monkeypatch):
    docs, items = table(400)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n", "2 AS terms", "3 AS score").repartition(3)
    q = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in ball_tree.search(d, q).collect()), key=str)
    assert got == plain(docs, items)
    monkeypatch.setattr(ball_tree, "BLOCK_TERMS", 20)  # several blocks of items
    assert sorted((tuple(r) for r in ball_tree.search(d, q, k=3).collect()), key=str) == plain(docs, items, 3)


def test_text_ids_and_empty_tables(spark):
    docs = [("b", "x y"), ("a", "x y"), ("c", "z")]
    d = spark.createDataFrame(docs, "doc_id string, text string")
    q = spark.createDataFrame([("i", "x")], "item_id string, text string")
    assert [(r.rank, r.doc_id) for r in ball_tree.search(d, q).orderBy("rank").collect()] == [(1, "a"), (2, "b")]
    assert ball_tree.search(d.limit(0), q).collect() == [] == ball_tree.search(d, q.limit(0)).collect()


def vectors(rng, n, width, groups):
    """Sparse rows in groups that share their terms."""
    starts, columns, values = [0], [], []
    for i in range(n):
        pool = np.arange(width) if groups == 1 else np.arange(width // groups) + (i % groups) * (width // groups)
        mine = np.sort(rng.choice(pool, size=rng.integers(1, 8), replace=False))
        columns += mine.tolist()
        values += rng.integers(1, 10**6, len(mine)).tolist()
        starts.append(len(columns))
    return np.array(starts), np.array(columns, np.int64), np.array(values, np.int64)


@pytest.mark.parametrize("groups", [1, 8])
def test_tree_bounds_hold_and_search_is_exact(groups):
    rng = np.random.default_rng(groups)
    starts, columns, values = vectors(rng, 1000, 160, groups)
    dense_rows = np.zeros((1000, 160), np.int64)
    dense_rows[np.repeat(np.arange(1000), np.diff(starts)), columns] = values
    df = (dense_rows > 0).sum(axis=0)
    weights = ball_tree.weight(df, 1000)
    items = [np.sort(rng.choice(160 // groups, 5, replace=False)) for _ in range(20)]
    query = ball_tree.Query(items, weights, df, 1000, 10)
    tree = ball_tree.BallTree(starts, columns, values, query.axes)
    read = 0
    for t in query.items:
        dense = np.zeros(160, np.int64)
        dense[t] = weights[t]
        score = dense_rows @ dense
        bounds = tree.bounds(t, weights)
        for node in range(len(tree.low)):
            members = tree.order[tree.low[node] : tree.high[node]]
            assert score[members].max() <= bounds[node]
        rows, got, leaves = tree.search(bounds, dense, 1, 10)
        want = np.sort(score[score > 0])[::-1][:10]
        assert (score[rows] == got).all() and np.array_equal(np.sort(got)[::-1][:10], want)
        tied = set(np.flatnonzero(score >= want[-1])) if len(want) == 10 else set(np.flatnonzero(score > 0))
        assert tied <= set(rows.tolist())
        read += leaves
    n_leaves = int((tree.left < 0).sum())
    if groups > 1:  # documents that share no term with an item lie in subtrees of their own
        assert read < 0.5 * n_leaves * len(items)


def test_lengths_beyond_64_bits():
    n = np.array([10, 10**9], np.int64)
    assert ball_tree.lengths(n, 10**11, 10**13).tolist() == [50 + 50 * 10 * 10**11 // 10**13, 50 + 50 * 10**9 * 10**11 // 10**13]


def test_long_texts_in_pieces(monkeypatch):
    monkeypatch.setattr(ball_tree, "PIECE_BYTES", 7)
    text = "alpha beta-gamma über delta " * 20
    assert [w.decode() for words in ball_tree._words(text.encode()) for w in words] == terms(text)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, problems = compare(spark, duck(folder), "op11_ball_tree", queries.op11_ball_tree, ball_tree.ORACLE, folder, verbose=False)
    assert ok, problems
