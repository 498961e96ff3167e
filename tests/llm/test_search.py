"""Hilbert-curve search: curve properties, recall and exact rows."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import hilbert_search as H
from riskflow.llm import queries


@pytest.mark.parametrize("dims,bits", [(2, 3), (3, 2), (4, 2)])
def test_keys_walk_the_whole_grid_one_step_at_a_time(dims, bits):
    cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
    keys = H.hilbert_keys(cells, bits)
    assert sorted(keys.tolist()) == list(range(len(cells)))
    walk = cells[np.argsort(keys)]
    assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def plain(rows, k=20, every=20):
    rows = [(i, np.array(e, float)) for i, e in rows if i is not None and e and None not in e and np.isfinite(e).all() and np.any(e)]
    out = {}
    for q, v in rows:
        if q % every == 0:
            near = sorted(((-float((e * v).sum()), i) for i, e in rows if i != q and len(e) == len(v)))[:k]
            out[q] = [(i, -s) for s, i in near]
    return out


def check_exact_rows(got, rows, k=20):
    """Ranks from 1, scores exact, order right; returns finds by query."""
    by = {}
    vectors = {i: np.array(e, float) for i, e in rows if i is not None and e and None not in e}
    for r in sorted(got, key=lambda r: (r.query_id, r.rank)):
        by.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(by[r.query_id]) <= k and r.vec_id != r.query_id
        assert r.score == pytest.approx(float((vectors[r.query_id] * vectors[r.vec_id]).sum()), rel=1e-12, abs=1e-12)
    for found in by.values():
        assert found == sorted(found, key=lambda f: (-f[1], f[0])) and len({i for i, _ in found}) == len(found)
    return by


def test_small_table_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in rng.standard_normal(6)]) for i in range(100)]
    rows += [(200 + i, rows[0][1]) for i in range(40)] + [(None, rows[1][1]), (300, None), (301, []), (302, [0.0] * 6),
             (303, [None] * 6), (304, [float("inf")] * 6), (320, [1.0, 2.0]), (321, [3.0, 1.0]), (340, [-0.0, 1.0] + [0.0] * 4)]
    df = spark.createDataFrame([(*r, 9.0) for r in rows + [rows[7]]], "vec_id long, embedding array<double>, score double")
    by = check_exact_rows(H.search(df, F.col("vec_id") % 20 == 0).collect(), rows)
    want = plain(rows)
    assert by.keys() == want.keys()
    for q in want:
        assert [i for i, _ in by[q]] == [i for i, _ in want[q]]
    few = df.where("vec_id < 5")
    assert H.search(few, F.col("vec_id") % 20 == 0).count() == 4
    assert H.search(df.where("false"), F.col("vec_id") % 20 == 0).collect() == []
    assert H.search(df.where("vec_id = 1"), F.col("vec_id") % 20 == 0).collect() == []


def test_structured_vectors_get_narrow_windows():
    rng = np.random.default_rng(0)
    centres = rng.standard_normal((400, 32)) * 4
    x = np.repeat(centres, 20, axis=0) + rng.standard_normal((8000, 32)) * 0.05
    curves = H.Curves(x)
    here, there = curves.places(x[::20]), curves.places(x[1::20])
    assert np.quantile(np.abs(here - there).min(axis=0), 0.96) < 0.02


def test_recall_in_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(H, "BLOCK_ROWS", 64)
    monkeypatch.setattr(H, "SPLIT_ROWS", 100)
    rng = np.random.default_rng(1)
    base = rng.standard_normal((60, 16))
    x = base[rng.integers(60, size=2000)] + rng.standard_normal((2000, 16)) * 0.2
    rows = [(i, [float(v) for v in e]) for i, e in enumerate(x)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    by = check_exact_rows(H.search(df, F.col("vec_id") % 20 == 0).collect(), rows)
    want = plain(rows)
    assert by.keys() == want.keys() and all(len(f) == 20 for f in by.values())
    hit = sum(len({i for i, _ in by[q]} & {i for i, _ in want[q]}) for q in want)
    assert hit >= 0.9 * 20 * len(want)


@pytest.mark.parametrize("sf", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_op9_on_the_table(spark, sf):
    rows = [(r.vec_id, list(r.embedding)) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    by = check_exact_rows(queries.QUERIES["op9_hilbert_search"](spark, sf).collect(), rows)
    want = plain(rows)
    assert by.keys() == want.keys() and all(len(f) == 20 for f in by.values())
    assert sum(len({i for i, _ in by[q]} & {i for i, _ in want[q]}) for q in want) >= 0.9 * 20 * len(want)
