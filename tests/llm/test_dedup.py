"""SimHash groups, components and cover-tree links against brute force."""

import random

import numpy as np
import pandas as pd
import pytest
import xxhash

from riskflow.llm import cover_tree, graph, queries, simhash


def plain_fingerprint(text, words=3):
    w = [x for x in __import__("re").split(rb"[\x20\x09-\x0d]+", (text or "").encode().lower()) if x]
    grams = [b" ".join(w[i : i + words]) for i in range(len(w) - words + 1)] or ([b" ".join(w)] if w else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(n, linked):
    low = list(range(n))
    while True:
        new = [min([low[i], *(low[j] for j in linked[i])]) for i in range(n)]
        if new == low:
            return low
        low = new


def plain_groups(ids, prints, bits=3):
    f = np.array(prints, np.uint64)
    near = np.bitwise_count(f[:, None] ^ f[None]) <= bits
    low = components(len(f), [np.flatnonzero(r) for r in near])
    least = {}
    for i, root in zip(ids, low):
        if i is not None:
            least[root] = min(i, least.get(root, i))
    return [least.get(root) for root in low]


@pytest.mark.parametrize("text", [
    None, "", "  \n", "one", "Two Words", "a b c", "A B\tc\nd", "É à b c d", "x" * 10_000, " ".join(map(str, range(3000))),
    "a b c " * 500, "tab\x0bvt\x0cff d e", "nbsp\xa0stays one b c",
])
def test_fingerprint(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_long_texts_in_pieces(monkeypatch):
    text = " ".join(f"w{i % 97}" for i in range(4000)) + " "
    want = plain_fingerprint(text)
    for size in (7, 64, 1000):
        monkeypatch.setattr(simhash, "PIECE_BYTES", size)
        assert simhash.fingerprint(text) == want
        assert simhash.fingerprint("lonely word" + " " * 300) == plain_fingerprint("lonely word")


def test_links_span_the_groups(spark, monkeypatch):
    rng = random.Random(11)
    prints = [rng.getrandbits(64) for _ in range(60)]
    for _ in range(3):  # neighbours at 1 to 5 bits, in chains and in one crowd
        prints += [p ^ sum(1 << b for b in rng.sample(range(64), rng.randint(1, 5))) for p in prints]
    prints += [prints[0] ^ (1 << a) ^ (1 << b) for a in range(0, 64, 3) for b in range(1, 64, 5)]
    prints = sorted(set(prints))
    want = plain_groups(prints, prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    for wide in (2048, 3):  # 3: nearly every shared key is cut again
        monkeypatch.setattr(simhash, "WIDE_KEY", wide)
        edges = simhash.links(spark.createDataFrame([(p,) for p in signed], "fp long")).collect()
        index = {p: i for i, p in enumerate(signed)}
        linked = [[] for _ in prints]
        for e in edges:
            assert (prints[index[e.a]] ^ prints[index[e.b]]).bit_count() <= 3
            linked[index[e.a]].append(index[e.b])
            linked[index[e.b]].append(index[e.a])
        low = components(len(prints), linked)
        assert [prints[i] for i in low] == want


def test_groups_of_documents(spark):
    base = " ".join(f"word{i}" for i in range(300))
    rows = [
        (5, base), (3, base), (3, base), (9, base + " tail"), (None, base), (None, None), (7, ""), (8, "  "),
        (11, "a few other words here"), (None, "alone without an id at all"), (2, None), (20, "x y z " * 2000),
    ]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, simhash.near_duplicates(df).collect()), key=str)
    prints = [plain_fingerprint(t) for _, t in rows]
    want = plain_groups([i for i, _ in rows], prints)
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    assert got == sorted([(i, f, c) for (i, _), f, c in zip(rows, signed, want)], key=str)
    kept = simhash.keep_first(df)
    assert kept.columns == df.columns
    kept = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert kept == sorted([(3, base), (2, None), (11, rows[8][1]), (None, rows[9][1]), (20, rows[11][1])]
                          + ([(9, rows[3][1])] if (prints[0] ^ prints[3]).bit_count() > 3 else []), key=str)


def test_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert simhash.near_duplicates(docs).collect() == []
    assert simhash.keep_first(docs).collect() == []
    vectors = spark.createDataFrame([], "vec_id long, embedding array<float>, label int")
    assert cover_tree.near_duplicates(vectors).collect() == []


def test_query_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op2_simhash_dedup"](spark, sf).toPandas().set_index("doc_id").sort_index()
    docs = spark.read.parquet(f"{sf}/documents.parquet").toPandas().set_index("doc_id").sort_index()
    prints = [plain_fingerprint(t) for t in docs.text]
    assert got.fingerprint.tolist() == [f"{p:016x}" for p in prints]
    assert got.component_id.tolist() == plain_groups(list(docs.index), prints)


def test_components_of_paths_stars_and_rings(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 100 + i) for i in range(1, 60)]
    edges += [(300 + i, 300 + (i + 1) % 17) for i in range(17)] + [(500, 500), (None, 3), (41, None)] + [(0, 1)] * 5
    rng.shuffle(edges)
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    want = {i: 0 for i in range(41)} | {100 + i: 100 for i in range(60)} | {300 + i: 300 for i in range(17)}
    assert got == want


def plain_links(rows, cosine):
    v = [None if e is None or label is None or i is None or None in e or not np.isfinite(e).all() or not np.any(e)
         else np.array(e, float) for i, e, label in rows]
    linked = [[] for _ in rows]
    for i in range(len(rows)):
        for j in range(len(rows)):
            if i != j and v[i] is not None and v[j] is not None and rows[i][2] == rows[j][2] and len(v[i]) == len(v[j]):
                if v[i] @ v[j] / np.sqrt((v[i] @ v[i]) * (v[j] @ v[j])) >= cosine:
                    linked[i].append(j)
    low = components(len(rows), linked)
    return [
        (r[0], len(linked[i]), (c := min((rows[j][0] for j in range(len(rows)) if low[j] == low[i] and rows[j][0] is not None), default=None)), c is not None and r[0] == c)
        for i, r in enumerate(rows)
    ]


def make_vectors(n, seed, dims=12):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.55:
            near = np.array(rows[rng.integers(len(rows))][1]) + rng.standard_normal(dims) * rng.choice([0, 0.02, 0.06, 0.12])
            rows.append((i, [float(x) for x in near], int(rng.integers(2))))
        else:
            rows.append((i, [float(x) for x in rng.standard_normal(dims)], int(rng.integers(2))))
    return rows


@pytest.mark.parametrize("block", [2048, 40])
def test_cover_tree_links(spark, monkeypatch, block):
    monkeypatch.setattr(cover_tree, "BLOCK", block)
    rows = make_vectors(220, 3)
    rows += [(900, rows[0][1], None), (901, None, 1), (902, [0.0] * 12, 1), (903, [float("nan")] + [1.0] * 11, 1),
             (904, [None] + [1.0] * 11, 1), (None, rows[1][1], 1), (905, [1.0, 2.0], 1), (906, [2.0, 4.0], 1), (907, [], 1)]
    rows += [rows[5], rows[5], (908, [1e200] * 12, 0), (909, [1e-200] * 12, 0)]
    df = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<double>, label int, key int")
    got = sorted(map(tuple, cover_tree.near_duplicates(df).collect()), key=str)
    safe = [(i, None if e is None else e if e and max(map(abs, filter(None, e)), default=0) < 1e100 and any(x and abs(x) > 1e-100 for x in e) else
             [x / 1e200 if x and x > 1 else x * 1e200 if x else x for x in e], label) for i, e, label in rows]
    assert got == sorted(plain_links(safe, 0.98), key=str)


def test_dual_traversal_visits_every_close_pair():
    rng = np.random.default_rng(0)
    base = rng.standard_normal((30, 8))
    points = np.concatenate([base + rng.standard_normal((30, 8)) * s for s in (0, 0.02, 0.05, 0.3, 1)])
    u = cover_tree.unit(points)
    far = cover_tree.reach(0.98)
    tree, other = cover_tree.CoverTree(u), cover_tree.CoverTree(u[::-1].copy())
    for node, members in enumerate(tree.members):  # radii cover, and halve from level to level
        gap = np.linalg.norm(u[members] - u[tree.centre[node]], axis=1)
        assert gap.max() <= tree.radius[node] + 1e-7
    met = np.zeros((150, 150), int)
    for x, y in cover_tree.close_pairs(tree, other, far):
        met[np.ix_(x, 149 - y)] += 1
    assert met.max() <= 1 and (met[u @ u.T >= 0.98] == 1).all()
    own = np.zeros((150, 150), int)
    for x, y in cover_tree.close_pairs(tree, tree, far):
        own[np.ix_(x, y)] += 1
    own = own + own.T
    assert (own[(u @ u.T >= 0.98) & ~np.eye(150, dtype=bool)] >= 1).all()


def test_op5_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.QUERIES["op5_cover_tree"](spark, sf).toPandas()
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    want = pd.DataFrame(plain_links(rows, 0.98), columns=["vec_id", "n_links", "component_id", "kept"])
    assert sorted(map(tuple, got.itertuples(index=False))) == sorted(map(tuple, want.itertuples(index=False)))
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    assert sorted(con.execute(queries.ORACLES["op5_cover_tree"]).fetchall()) == sorted(map(tuple, got[["vec_id", "n_links", "component_id", "kept"]].itertuples(index=False)))


def test_op5_sql_twin_with_links(spark):
    import duckdb

    rows = [r for r in make_vectors(150, 8) if r[0] is not None] + [(901, [0.0] * 12, 1), (902, None, 1), (903, [1.0] * 12, None)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    con = duckdb.connect()
    con.execute("CREATE TABLE embeddings (vec_id BIGINT, embedding DOUBLE[], label INTEGER)")
    con.executemany("INSERT INTO embeddings VALUES (?, ?, ?)", rows)
    want = sorted(con.execute(cover_tree.ORACLE).fetchall())
    assert sum(n for _, n, _, _ in want) > 50
    assert sorted(map(tuple, cover_tree.near_duplicates(df).collect())) == want
