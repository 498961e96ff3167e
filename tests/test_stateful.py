"""Documents as state on the stream: equal to batch, late pages, restart."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from riskflow.operators import entities as oe
from riskflow.streaming import stateful as ss
from riskflow.streaming import streams as st

START = dt.datetime(2024, 1, 1)


def page(doc, number, minute, text):
    return (doc, number, text, START + dt.timedelta(minutes=minute))


SCHEMA = "doc_id long, page_number int, text string, ts timestamp"


@pytest.fixture()
def rocksdb(spark):
    old = spark.conf.get(ss.STATE_STORE)
    ss.use_rocksdb(spark)
    yield
    spark.conf.set(ss.STATE_STORE, old)


def feed(spark, folder, *batches):
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(f"{folder}/in")


def run(spark, folder):
    stream = st.read_table_stream(spark, f"{folder}/in", "*.parquet", max_files_per_trigger=1)
    docs = ss.stream_documents(stream, delay="5 minutes", idle_ms=600_500)
    out = docs.select("doc_id", "page_count", "entity_summary", "summary_entries")
    (out.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/ckpt")
     .trigger(availableNow=True).start().awaitTermination())
    return {r.doc_id: r for r in spark.read.schema(out.schema).parquet(f"{folder}/out").collect()}


def batch(spark, rows):
    pages = spark.createDataFrame(rows, SCHEMA)
    found = oe.summarize_entities(oe.dedup_entities(oe.extract_entities(pages, clean=True, offsets=False)))
    return {r.doc_id: r for r in found.collect()}


def test_documents_over_batches_equal_batch(spark, tmp_dir, rocksdb):
    first = [page(1, 2, 0, "theft and fire, $500"), page(2, 0, 1, "no entity here"), page(3, 0, 2, None)]
    second = [page(1, 0, 6, "fire and flood  PLY-2024-00892"), page(1, 1, 7, "Fire theft general liability")]
    third = [page(9, 0, 60, "settled")]
    feed(spark, tmp_dir, first, second, third)
    got, want = run(spark, tmp_dir), batch(spark, first + second)
    assert set(got) == {1, 2, 3}  # the last document is still open
    assert got[1].entity_summary == want[1].entity_summary and got[1].page_count == 3
    assert [e.label for e in got[1].summary_entries] == [e.label for e in want[1].summary_entries]
    assert got[2].entity_summary == {} == got[3].entity_summary


def test_late_pages_are_left_out_and_restart_goes_on(spark, tmp_dir, rocksdb):
    feed(spark, tmp_dir, [page(1, 0, 0, "fire")], [page(2, 0, 30, "flood")])
    assert set(run(spark, tmp_dir)) == {1}
    # document 1 has closed; its late page is behind the watermark. Document 2 goes on after the restart.
    feed(spark, tmp_dir, [page(1, 1, 1, "theft"), page(2, 1, 34, "hail damage")], [page(3, 0, 90, "collapse")])
    got = run(spark, tmp_dir)
    assert set(got) == {1, 2} and got[1].entity_summary == {"PERIL": ["fire"]}
    assert got[2].entity_summary == {"PERIL": ["flood", "hail damage"]} and got[2].page_count == 2


def test_merged_keeps_confidence_and_first_place():
    e = lambda text, conf, page, span: (text.lower(), "L", text, conf, page, span, page, span)
    (one,) = ss.merged([e("Fire", 0.85, 3, 0), e("fire", 1.0, 5, 1), e("FIRE", 1.0, 4, 9), e("fIRE", 0.2, 1, 7)])
    assert one == ("fire", "L", "FIRE", 1.0, 4, 9, 1, 7)
    again = ss.merged([ss.merged([e("Fire", 0.85, 3, 0), e("fire", 1.0, 5, 1)])[0], *ss.merged([e("FIRE", 1.0, 4, 9), e("fIRE", 0.2, 1, 7)])])
    assert again == [one]


def test_long_documents_are_compacted(spark, tmp_dir, rocksdb, monkeypatch):
    words = ["fire", "flood", "theft", "vandalism", "lightning", "explosion", "collapse", "hurricane", "tornado", "earthquake"]
    batches = [[page(1, b * 10 + i, b, f"{words[i]} ${b * 10 + i}") for i in range(10)] for b in range(9)]
    feed(spark, tmp_dir, *batches, [page(2, 0, 60, "x")])
    got = run(spark, tmp_dir)
    want = batch(spark, [r for b in batches for r in b])
    assert got[1].entity_summary == want[1].entity_summary and got[1].page_count == 90


def test_documents_are_sessions_without_python(spark, tmp_dir, rocksdb):
    # idle for longer than the limit between two pages of one batch: two rows; repeats count once, in first-seen order
    pages = [page(1, 0, 0, "fire, FIRE $5 fire"), page(1, 1, 4, "flood $5"), page(1, 2, 40, "theft"), page(None, 0, 1, "hail damage")]
    feed(spark, tmp_dir, pages, [page(2, 0, 90, "x")])
    stream = st.read_table_stream(spark, f"{tmp_dir}/in", "*.parquet", max_files_per_trigger=1)
    docs = ss.stream_documents(stream, delay="5 minutes", idle_ms=600_500)
    assert "Python" not in docs._jdf.queryExecution().logical().toString() + docs._jdf.queryExecution().analyzed().toString()
    (docs.writeStream.format("parquet").option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ckpt")
     .trigger(availableNow=True).start().awaitTermination())
    rows = spark.read.schema(docs.schema).parquet(f"{tmp_dir}/out").collect()
    got = sorted((r.doc_id or 0, r.page_count, [(e.label, e["values"]) for e in r.summary_entries]) for r in rows)
    assert got == [(0, 1, [("PERIL", ["hail damage"])]), (1, 1, [("PERIL", ["theft"])]),
                   (1, 2, [("PERIL", ["fire", "flood"]), ("MONEY", ["$5"])])]
