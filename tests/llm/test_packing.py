"""Pattern packing: ids against the library, places against the rules."""

import bisect
import math
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from tokenizers import Tokenizer

from riskflow.llm import packing, queries

PATH = P.path("word_bpe_49k.json")


def library_pieces(lib, text, most):
    ids = lib.encode(text or "", add_special_tokens=False).ids + [1]
    return [(k, a, min(most, len(ids) - a), zlib.crc32(np.array(ids[a : a + most], "<u4").tobytes()))
            for k, a in enumerate(range(0, len(ids), most))]


def check_places(rows, most):
    """Gapless from 0 in every sequence, none too long; returns their number."""
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end and length > 0
            end += length
        assert end <= most
    return len(by)


def test_ids_are_the_librarys():
    lib = Tokenizer.from_file(PATH)
    texts = ["", None, " ", "Hello, WORLD's", "a" * 3000, "<|endoftext|>x <|ENDOFTEXT|>", "ÅSTRÖM É é İ Σ", "漢字 12३ \U0001f600",
             "x\x0by\x0cz w v \x1c", "café ̈a"]
    with open(PATH, encoding="utf-8") as f:
        got = packing.WordIds(f.read()).encode(texts)
    for t, data in zip(texts, got):
        assert np.frombuffer(data, np.uint32).tolist() == lib.encode(t or "", add_special_tokens=False).ids, t


def best_fit_decreasing(have, most):
    room, n = [], 0
    for x in range(most, 0, -1):
        for _ in range(int(have[x])):
            i = bisect.bisect_left(room, x)
            left = room.pop(i) if i < len(room) else most
            n += left == most
            if left > x:
                bisect.insort(room, left - x)
    return n


@pytest.mark.parametrize("seed", range(4))
def test_plan_places_every_piece_once(seed):
    rng = np.random.default_rng(seed)
    most = 64
    have = np.zeros(most + 1, np.int64)
    if seed:
        have[1:] = rng.integers(0, [1, 5, 400, 3][seed] * 10, most) * (rng.random(most) < [1, 0.2, 0.9, 0.5][seed])
    plan = packing.plan(have, most)
    seen = np.zeros(most + 1, np.int64)
    used = {}
    order = np.lexsort((plan["rank"], plan["length"]))
    assert (order == np.arange(len(order))).all()
    for i in range(len(order)):
        length, rank = plan["length"][i], plan["rank"][i]
        last = i + 1 == len(order) or plan["length"][i + 1] != length
        end = have[length] if last else plan["rank"][i + 1]
        assert rank == seen[length]
        for r in range(rank, end):
            j = r - rank
            used.setdefault(plan["sequence"][i] + j % plan["repeats"][i], []).append(
                (plan["offset"][i] + j // plan["repeats"][i] * length, length))
        seen[length] = end
    assert (seen == have).all()
    for places in used.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= most
    assert len(used) <= best_fit_decreasing(have, most)


def test_fit_is_non_negative_least_squares():
    have = np.zeros(11, np.int64)
    have[[2, 3, 4, 6, 7, 10]] = [4, 9, 5, 5, 9, 3]
    patterns = packing.enumerate_patterns(have, 10)
    assert all(p.sum() == 10 for p in patterns)
    x = packing.fit_counts(patterns, have)
    assert (x >= 0).all()
    used = np.zeros((11, len(patterns)))
    for j, p in enumerate(patterns):
        for length in p[p > 0]:
            used[length, j] += 1
    slope = used.T @ (used @ x - have)  # optimal: no slope where x > 0, none downhill where x = 0
    assert (np.abs(slope[x > 1e-6]) < 1e-2).all() and (slope > -1e-2).all()


def test_pack_documents(spark):
    lib = Tokenizer.from_file(PATH)
    texts = [None, "", "one", "word " * 100, "word " * 5000, "same text here"] + ["same text here"] * 300 + [f"{'w ' * (i % 60)}end" for i in range(400)]
    rows = [(None if i == 3 else i % 650, t, -5) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, length int")
    shared = packing.word_ids(spark, PATH)
    got = packing.pack(df, shared, max_tokens=64).collect()
    want = sorted(((i, *p) for i, t, _ in rows for p in library_pieces(lib, t, 64)), key=str)
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got), key=str) == want
    n = check_places(got, 64)
    assert n <= math.ceil(sum(r.length for r in got) / 64) * 1.02 + 1
    assert packing.pack(df.where("false"), shared).collect() == []


def test_op6_on_the_table(spark):
    sf = "/root/testdata/sf0.01"
    lib = Tokenizer.from_file(PATH)
    got = queries.QUERIES["op6_pattern_packing"](spark, sf).collect()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted((r.doc_id, *p) for r in docs for p in library_pieces(lib, r.text, 4096))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    assert check_places(got, 4096) <= math.ceil(sum(r.length for r in got) / 4096) + 1
