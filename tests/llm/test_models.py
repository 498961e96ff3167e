"""Quality classifier and language ID: held-out accuracy and edge cases."""

import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskflow.llm import language, quality, queries

SF = "/root/testdata/sf0.1"


def held(i):
    return zlib.crc32(str("" if i is None else i).encode()) % 5 == 0


def plain_features(text):
    """The n-grams one by one, in a dictionary."""
    mask = (1 << 64) - 1
    m1, m2, m3 = (int(m) for m in (quality._M1, quality._M2, quality._M3))
    codes = [quality._code(w) for w in quality._WORDS(text or "")]
    word = [c[0] for c in codes]
    form = [int(quality._SAME) if i and word[i] == word[i - 1] else c[1] for i, c in enumerate(codes)]
    grams = [w * m1 & mask for w in word] + [f * m2 & mask for f in form]
    for seq, salt in ((word, m3), (form, m1)):
        grams += [((a * m2 & mask) + b & mask) * salt & mask for a, b in zip(seq, seq[1:])]
    grams += [((((a * m2 & mask) + b & mask) * m3 & mask) + c & mask) * m2 & mask for a, b, c in zip(form, form[1:], form[2:])]
    count = {}
    for g in grams:
        count[g >> (64 - quality.BITS)] = count.get(g >> (64 - quality.BITS), 0) + 1
    norm = math.sqrt(sum(c * c for c in count.values()))
    return {i: c / norm for i, c in count.items()}


@pytest.mark.parametrize("text", [None, "", " ", "one", "One two", "A a a a!! b** 12 _x", "word. " * 400 + "TAIL!!", "é ü 漢字 !!"])
@pytest.mark.parametrize("piece", [1 << 20, 16])
def test_features(monkeypatch, text, piece):
    monkeypatch.setattr(quality, "PIECE_CHARS", piece)
    at, x = quality.features(text)
    want = plain_features(text)
    assert dict(zip(at.tolist(), np.round(x, 12))) == {i: round(v, 12) for i, v in want.items()}


def test_fold_counts_the_same():
    one = [np.arange(1000, dtype=np.uint64) << np.uint64(46), np.arange(7, dtype=np.uint64)]
    dense = quality._fold([*quality._fold(one), *one])[0]
    assert (dense == 2 * quality._fold(one)[0]).all() and dense.sum() == 2 * 1007


@pytest.mark.parametrize("text", ["word. " * 400 + "TAIL!!", "BUY now!! é 12 x x x " * 60, "a b " * 30 + " " * 400 + "c!"])
@pytest.mark.parametrize("grams", [0, 20, 90])
def test_features_of_texts_folded_several_times(monkeypatch, text, grams):
    folds, fold = [], quality._fold
    monkeypatch.setattr(quality, "PIECE_CHARS", 16)
    monkeypatch.setattr(quality, "FOLD_GRAMS", grams, raising=False)
    monkeypatch.setattr(quality, "_fold", lambda found: folds.append(1) or fold(found))
    at, x = quality.features(text)
    assert len(folds) > 1
    assert dict(zip(at.tolist(), np.round(x, 12))) == {i: round(v, 12) for i, v in plain_features(text).items()}


def test_quality_on_held_out_rows(spark):
    got = queries.QUERIES["op1_quality_classifier"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert len(got) == docs.count()
    assert (got.held_out == got.doc_id.map(held)).all()
    assert got.score.between(0, 1).all() and (got.predicted == (got.score >= 0.3)).all()
    labels = spark.read.parquet(f"{SF}/labels.parquet").toPandas()
    both = got[got.held_out].merge(labels, on="doc_id")
    right = both.predicted == both.quality
    assert right.mean() > 0.97
    assert right[both.quality == 1].mean() > 0.99  # clean documents stay
    assert right[both.quality == 0].mean() > 0.85


def test_quality_edge_cases(spark):
    good, bad = "The quick fox jumps over a lazy dog near town. ", "BUY!! NOW!! CHEAP!! CLICK!! HERE!! "
    docs = [(i, (good if i % 2 else bad) * (1 + i % 5), 0.5, "x") for i in range(60)]
    docs += [(None, good, 0.1, "x"), (100, None, 0.1, "x"), (101, "", 0.1, "x"), (102, bad * 5000, 0.1, "x"), (1, docs[1][1], 0.5, "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, predicted string")
    labels = [(i, i % 2, None) for i in range(60)] + [(3, 0, 1), (None, 1, 0), (100, None, 0), (500, 1, 0), (1, 1, 0)]
    lab = spark.createDataFrame(labels, "doc_id long, quality int, text string")
    got = quality.classify(df, lab).collect()
    assert len(got) == len(docs)
    by = {r.doc_id: r for r in got}
    assert by[None].held_out is True and by[102].predicted == 0 and by[7].predicted == 1 and by[8].predicted == 0
    assert by[100].score == by[101].score
    kept = quality.keep_good(df, lab)
    assert kept.columns == df.columns
    assert sorted(r.doc_id for r in kept.where("doc_id < 60").collect()) == sorted([1, *range(1, 60, 2)])
    none = lab.where("false")
    assert {r.score for r in quality.classify(df, none).collect()} == {0.5}
    assert quality.classify(df.where("false"), lab).collect() == []
    assert quality.classify(df, lab.where("quality = 1")).where("predicted = 0").collect() == []


def test_sample_is_bounded_and_skips_held_out(spark):
    docs = spark.range(400).select(F.col("id").alias("doc_id"), F.lit("a text").alias("text"))
    docs = docs.unionByName(docs.where("doc_id = 1").crossJoin(spark.range(50)).drop("id"))
    labels = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 4 > 0).cast("int").alias("quality"))
    rows = quality.training_sample(docs, labels, "doc_id", "text", 30).groupBy("y").count().collect()
    assert {r.y: r["count"] for r in rows} == {0: 30, 1: 30}
    most = quality.training_sample(docs, labels, "doc_id", "text", 10_000).count()
    assert most == sum(not held(i) for i in range(400))


def test_class_rates_are_of_the_labels_that_teach(spark):
    good, bad = "The quick fox jumps over a lazy dog near town. ", "BUY!! NOW!! CHEAP!! CLICK!! HERE!! "
    docs = spark.createDataFrame([(i, (good if i % 2 else bad) * (1 + i % 3)) for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2) for i in range(60)]
    taught = [i for i in range(50) if not held(i)]
    variants = [
        [(i, 1 - y if held(i) else y) for i, y in labels],  # held-out labels changed
        [(i, y) for i, y in labels if not held(i)],  # none of them
        labels + [labels[taught[0]]] * 500,  # one label row repeated
        labels + [(None, 0)] * 500 + [(taught[1], None)] * 9,  # labels of no document, null labels
    ]
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, quality int")
    want = quality.train(docs, frame(labels), rows_per_class=10)
    for rows in variants:
        assert np.allclose(quality.train(docs, frame(rows), rows_per_class=10), want, rtol=0, atol=1e-6)
    twice = labels + [(taught[2], 1 - labels[taught[2]][1])]  # a contradicted label is as none
    without = [x for x in labels if x[0] != taught[2]]
    assert np.allclose(quality.train(docs, frame(twice)), quality.train(docs, frame(without)), rtol=0, atol=1e-6)


def test_language_on_held_out_rows(spark):
    got = queries.QUERIES["op8_language_id"](spark, SF).toPandas()
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").toPandas()
    assert len(got) == len(docs) and (got.held_out == got.doc_id.map(held)).all()
    assert got.score.between(0, 1).all() and set(got.lang_pred) <= {*docs.lang, "und"}
    both = got[got.held_out].merge(docs, on="doc_id")
    assert (both.lang_pred == both.lang).mean() > 0.98


def test_language_edge_cases(spark):
    words = {"xx": "lorem ipsum dolor sit amet consectetur ", "yy": "żółw gęś jaźń łódź ćma śnieg "}
    docs = [(i, words["xx" if i % 2 else "yy"] * (1 + i % 3), "xx" if i % 2 else "yy", 1.0) for i in range(40)]
    odd = [(None, "lorem ipsum", "xx"), (50, None, "xx"), (51, "", "xx"), (52, "123 ?! --", "yy"), (53, "²³ ½", None),
           (54, "GĘŚ " * 200_000, None), (55, "ipsum", None), (3, "żółw", "yy")]
    df = spark.createDataFrame([*docs, *((*o, 2.0) for o in odd)], "doc_id long, text string, lang string, lang_pred double")
    got = language.identify(df).collect()
    assert len(got) == len(docs) + len(odd)
    by = {r.doc_id: r for r in got if r.doc_id != 3}
    assert {by[i].lang_pred for i in (50, 51, 52, 53)} == {"und"} and by[52].score == 0
    assert by[54].lang_pred == "yy" and by[55].lang_pred == "xx" and by[None].held_out is True
    assert all(by[i].lang_pred == ("xx" if i % 2 else "yy") for i in range(40) if i != 3)
    kept = language.keep_known(df)
    assert kept.columns == df.columns and kept.count() == len(got) - 4
    unlearned = df.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language.identify(unlearned).collect()} == {"und"}
    assert language.identify(df.where("false")).collect() == []


def test_kernel_is_presence_of_shared_grams():
    texts = ["abc abd", "abc xyz", "xyz xyw", "abd abc abc"]
    model = language.Model(texts, ["a", "a", "b", "a"])
    sets = [set(language.presence(t)) & set(model.kept) for t in texts]
    rows = model._rows([language.presence(t) for t in texts])
    own = model._kernel(rows)
    order = [0, 1, 3, 2]  # landmarks by language
    for i in range(4):
        for j, k in enumerate(order):
            want = len(sets[i] & sets[k]) / math.sqrt(max(1, len(sets[i])) * max(1, len(sets[k])))
            assert abs(own[i, j] - want) < 1e-6
    assert len(language.presence("a" * 50)) == len(language.presence("aaaa"))  # counts do not matter


def test_pieces_of_long_texts_have_the_same_grams(monkeypatch):
    text = "Über  den 12 Wolken, été! " * 40
    whole = set(language.presence(text).tolist())
    monkeypatch.setattr(language, "PIECE_CHARS", 1000)
    assert set(language.presence(text).tolist()) == whole
