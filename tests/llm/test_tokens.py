"""Byte-level BPE and token counts against the libraries themselves."""

import hashlib
import json
import random

import public_tokenizers as P
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskflow.llm import byte_bpe, queries, token_counts

ODD = [
    None, "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "\n", "a\n\nb c", "it's we'll 's", "<|endoftext|>",
    "x<|endoftext|> y<|endoftext|", "a" * 5000, "ab" * 9000, "né ü ß 漢字 \U0001f600 ॥ ՘'s 　x", "1234 १२ ²", "\x1c\x85 a",
    "same text", "same text",
]


def texts():
    rng = random.Random(5)
    signs = list("aaabe 's ll  \n\t\r.,!é漢ñ1२  ́\U0001f600ՙ՘ह\x1c")
    return ODD + ["".join(rng.choice(signs) for _ in range(rng.randint(0, 40))) for _ in range(600)]


@pytest.fixture(scope="module")
def ranks():
    return byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken"))


def test_perfect_hash_finds_its_keys_and_no_other(ranks):
    keys = sorted(ranks)[:5000]
    table = byte_bpe.PerfectHash(keys)
    assert [table.find(k) for k in keys] == list(range(len(keys)))
    assert sorted(table.values) == list(range(len(keys)))  # minimal: every slot is a key
    assert all(table.find(k + b"\x00?") == -1 for k in keys)
    assert byte_bpe.PerfectHash([]).find(b"a") == -1


def test_encode_and_decode_match_library(spark, ranks):
    lib = tiktoken.Encoding("t", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = [(i, t, -1) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids int")  # ids: a clashing name
    shared = byte_bpe.encoder(spark, P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
    ids = byte_bpe.encode(F.col("text"), shared)
    got = df.select("doc_id", "text", ids.alias("a"), byte_bpe.decode(ids, shared).alias("b"),
                    byte_bpe.round_trip(F.col("text"), shared).alias("r")).collect()
    assert len(got) == len(rows)
    for r in got:
        want = lib.encode_ordinary(r.text or "")
        assert list(r.a) == want == list(r.r.ids), r.text
        assert bytes(r.b) == (r.text or "").encode() == bytes(r.r.decoded)


def test_counts_match_library(spark):
    path = P.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    rows = [(i, t) for i, t in enumerate(texts())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    shared = token_counts.counter(spark, path)
    got = df.select("text", token_counts.count_tokens(F.col("text"), shared).alias("n")).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n == len(lib.encode(r.text or "", add_special_tokens=False).ids), r.text


def test_merged_symbols_are_the_library_tokens():
    with open(P.path("byte_bpe_50k.json"), encoding="utf-8") as f:
        spec = json.load(f)
    lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    merges = token_counts.Merges(spec["model"])
    words = ["banana", " internationalisation", "aaaaaaaaaaa", "!", " zzzzyzzz"]
    ids, sizes = merges.symbols([w.encode() for w in words])
    want = [lib.encode(w, add_special_tokens=False).ids for w in words]
    assert sizes.tolist() == [len(w) for w in want]
    assert ids.tolist() == sum(want, [])


def test_merge_order_is_checked():
    model = {"vocab": {**{c: i for i, c in enumerate(token_counts.byte_letters().values())}, "abc": 256, "ab": 257},
             "merges": ["ab c", "a b"]}
    with pytest.raises(ValueError):
        token_counts.Merges(model)


@pytest.mark.parametrize("name", ["op4_byte_bpe", "op7_token_counts"])
def test_queries_on_the_table(spark, name):
    got = queries.QUERIES[name](spark, "/root/testdata/sf0.001").toPandas().set_index("doc_id")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").toPandas().set_index("doc_id").text
    assert len(got) == len(docs)
    if name == "op4_byte_bpe":
        lib = tiktoken.Encoding("t", pat_str=P.PATTERN, special_tokens={},
                                mergeable_ranks=byte_bpe.read_ranks(P.path("byte_bpe_multi_50k.tiktoken")))
        for i, text in docs.items():
            ids = lib.encode_ordinary(text)
            assert got.n_tokens[i] == len(ids)
            assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
            assert got.decoded_sha256[i] == hashlib.sha256(text.encode()).hexdigest()
    else:
        lib = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
        for i, text in docs.items():
            n = len(lib.encode(text, add_special_tokens=False).ids)
            assert (got.n_bytes[i], got.n_tokens[i], got.over_limit[i]) == (len(text.encode()), n, n > 512)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    shared = token_counts.counter(spark, P.path("byte_bpe_50k.json"))
    assert df.select(token_counts.count_tokens(F.col("text"), shared)).collect() == []
