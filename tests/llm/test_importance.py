"""Importance resampling against a plain loop and its SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from riskflow.llm import importance, queries
from tools.check_oracles import compare, duck

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_features(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    runs = [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]
    return len(words), [zlib.crc32(r.encode()) for r in runs]


def plain(docs, target, n, buckets, least, percent):
    found = [(i, *plain_features(t, n)) for i, t in docs]
    s = Counter(f % buckets for *_, fs in found for f in fs)
    t = Counter(f % buckets for x in target for f in plain_features(x, n)[1])
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + buckets) / ((s[b] + 1) * (big_t + buckets)))) for b in range(buckets)]
    rows = []
    for i, words, fs in found:
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        w = sum(gain[f % buckets] for f in fs)
        rows.append([i, words, len(fs), w, w + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    can = sorted((r for r in rows if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = {id(r): k for k, r in enumerate(can[: percent * len(can) // 100], 1)}
    return sorted((tuple(r) + (drawn.get(id(r)),) for r in rows), key=str)


def sample(n):
    rng = random.Random(2)
    words = [f"w{i}" for i in range(50)] + ["The", "THE", "é漢", "_", "x.y", "9", "A_B"]
    docs = [(i, rng.choice([" ", "\n", "/"]).join(rng.choices(words, k=rng.randint(0, 60)))) for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, " ...\n"), (None, "w1 " * 30), (5, docs[5][1]), (n + 3, "ende " * 4000)]
    return docs, [" ".join(rng.choices(words[:10], k=20)) for _ in range(15)] + [None, ""]


@pytest.mark.parametrize("n, chunk", [(1, 1 << 21), (1, 300), (3, 200)])
def test_resample_equals_plain_loop(spark, monkeypatch, n, chunk):
    docs, target = sample(300)
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 AS n_words", "2 AS rank", "3 AS got")
    t = spark.createDataFrame([(x,) for x in target], "text string")
    got = importance.resample(d, t, n=n, buckets=97, least_words=20, percent=10).collect()
    assert sorted((tuple(r) for r in got), key=str) == plain(docs, target, n, 97, 20, 10)
    monkeypatch.setattr(importance, "CHUNK_BYTES", chunk)  # here, not in the workers: the pieces themselves
    for _, text in docs:
        data, want = (text or "").encode(), plain_features(text, n)
        whole = [f for _, found, _ in importance.features([data, b"other words", data], n, 1 << 32) for f in found.tolist()]
        assert Counter(whole) == Counter(want[1] * 2 + plain_features("other words", n)[1])


def test_no_run_crosses_documents():
    (owner, found, words), = importance.features([b"a b", b"", b"c", None, b"d e f"], 2, 1 << 32)
    assert Counter(owner.tolist()) == {0: 3, 2: 1, 4: 5} and words.tolist() == [2, 0, 1, 0, 3]
    assert zlib.crc32(b"b c") not in found.tolist()


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert importance.resample(docs.limit(0), docs).collect() == []
    (r,) = importance.resample(docs, docs.limit(0), least_words=1, percent=100).collect()
    assert (r.n_features, r["rank"]) == (3, 1)


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    ok, problems = compare(spark, duck(folder), "op13", queries.op13_importance_resampling, importance.ORACLE, folder, verbose=False)
    assert ok, problems
