"""Streams give the batch answer (on closed windows / whole input)."""

import os

from pyspark.sql import functions as F

from riskflow.operators import entities as oe
from riskflow.plans import views
from riskflow.streaming import streams as st

from .conftest import SF_SMALL


def test_foreach_batch_summaries_equal_batch(spark, tmp_dir):
    pages = views.submission_pages(spark, SF_SMALL)
    src = f"{tmp_dir}/pages"
    # three files -> three micro-batches; a document's pages may span files
    pages.withColumn("part", F.col("page_number") % 3).write.partitionBy("part").parquet(src)
    stream = spark.readStream.schema(spark.read.parquet(src).schema).option("maxFilesPerTrigger", 1).parquet(src)
    ents = st.stream_entities(stream.select("doc_id", "page_number", "text"))
    q = (ents.writeStream.foreachBatch(st.summary_batch_writer(f"{tmp_dir}/ents", f"{tmp_dir}/summ", buckets=16))
         .option("checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start())
    q.awaitTermination()
    got = {r["doc_id"]: r["entity_summary"] for r in st.latest_summaries(spark, f"{tmp_dir}/summ").collect()}
    batch = oe.summarize_entities(oe.dedup_entities(oe.extract_entities(pages, clean=True)))
    want = {r["doc_id"]: r["entity_summary"] for r in batch.collect()}
    assert got == want


def test_audit_stream_sink(spark, tmp_dir):
    src = f"{tmp_dir}/audit_src"
    spark.createDataFrame([("a", "HIGH"), ("b", "LOW")], "submission_id string, risk_tier string").write.parquet(src)
    stream = spark.readStream.schema("submission_id string, risk_tier string").parquet(src)
    q = st.stream_audit(stream, f"{tmp_dir}/audit", f"{tmp_dir}/audit_ckpt")
    q.awaitTermination()
    assert spark.read.json(f"{tmp_dir}/audit").count() == 2
    q2 = st.stream_audit(stream, f"{tmp_dir}/audit", f"{tmp_dir}/audit_ckpt")  # restart: nothing new
    q2.awaitTermination()
    assert spark.read.json(f"{tmp_dir}/audit").count() == 2


def test_sliding_windows_batch_equals_stream(spark):
    from riskflow.operators import monitor as om

    ev = views.requests(spark, SF_SMALL)
    batch = om.request_rate(ev, "service", "10 minutes", "5 minutes")
    stream = st.with_event_time(views.requests_from(st.read_table_stream(spark, SF_SMALL, "events.parquet")))
    out = st.run_to_table(st.stream_request_rate(stream, "service", "10 minutes", "5 minutes"), "t_sliding")
    max_ts = ev.agg(F.max("ts")).first()[0]
    import datetime as dt

    closed = batch.where(F.col("window_start") + F.expr("INTERVAL 10 MINUTES") <= F.lit(max_ts - dt.timedelta(minutes=10)))
    key = lambda r: (r["window_start"], r["service"], r["n"])
    assert sorted(map(key, out.collect())) == sorted(map(key, closed.collect()))


def test_over_limit_stream_equals_batch(spark):
    """Chained windows on the stream: sliding windows over counts a minute give
    the counts of sliding windows over the requests themselves."""
    import datetime as dt

    ev = views.requests(spark, SF_SMALL)
    stream = st.with_event_time(views.requests_from(st.read_table_stream(spark, SF_SMALL, "events.parquet")))
    out = st.run_to_table(st.stream_over_limit(stream, "client", 2, "6 hours", "2 hours"), "t_over_limit")
    wide = ev.groupBy(F.window("ts", "6 hours", "2 hours").alias("w"), "client").agg(F.count(F.lit(1)).alias("n"))
    latest = ev.agg(F.max("ts")).first()[0] - dt.timedelta(minutes=10)
    want = wide.where((F.col("n") > 2) & (F.col("w.end") <= F.lit(latest))).select(F.col("w.start").alias("window_start"), "client", "n")
    assert sorted(map(tuple, out.select("window_start", "client", "n").collect())) == sorted(map(tuple, want.collect()))


def test_request_trace_stream_with_late_and_missing_completions(spark, tmp_dir):
    """Pairs, a completion after the timeout, one that never comes, and a start
    that is still waiting; two micro-batches."""
    import datetime as dt

    at = lambda m: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=m)
    batches = [[(1, "s", at(0)), (2, "s", at(1)), (3, "s", at(2)), (1, "c", at(4))],
               [(2, "c", at(45)), (4, "s", at(118)), (5, "s", at(120)), (9, "c", at(120)), (5, "c", at(121))]]
    for rows in batches:
        spark.createDataFrame(rows, "request_id long, phase string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_dir}/in")
    feed = lambda phase: st.read_table_stream(spark, f"{tmp_dir}/in", "*.parquet", max_files_per_trigger=1).where(F.col("phase") == phase)
    got = st.run_to_table(st.stream_request_trace(feed("s"), feed("c")), "t_trace").collect()
    # request 2 completed after 44 minutes: too late; 3 never; 4 still waits
    assert sorted((r.request_id, r.duration_ms, r.complete) for r in got) == [
        (1, 240_000.0, True), (2, None, False), (3, None, False), (5, 60_000.0, True)]


def _page_files(spark, query):
    """How many files of pages a streaming query of this session wrote for itself."""
    import glob

    from riskflow.plans import registry
    from riskflow.session import checkpoint_dir

    seen = set(glob.glob(f"{checkpoint_dir(spark)}/stream-*/pages/*.parquet"))
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        registry.load_all()
        registry.QUERIES[query](spark, SF_SMALL).count()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)
    return len(set(glob.glob(f"{checkpoint_dir(spark)}/stream-*/pages/*.parquet")) - seen)


def test_arrivals_are_written_by_many_tasks(spark):
    assert _page_files(spark, "stream_features") > 4
    assert _page_files(spark, "stream_submissions") > 3


def test_nested_entities_of_a_stream_are_summarised_from_what_was_written(spark, tmp_dir):
    pages = views.submission_pages(spark, SF_SMALL).where("doc_id < 300")
    pages.withColumn("part", F.col("page_number") % 2).write.partitionBy("part").parquet(f"{tmp_dir}/pages")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_dir}/pages").schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_dir}/pages")
    ents = st.stream_entities(stream.select("doc_id", "page_number", "text"), nested=True)
    ents.writeStream.foreachBatch(st.summary_batch_writer(f"{tmp_dir}/ents", f"{tmp_dir}/summ", buckets=4)).option(
        "checkpointLocation", f"{tmp_dir}/ckpt").trigger(availableNow=True).start().awaitTermination()
    got = {r["doc_id"]: r["entity_summary"] for r in st.latest_summaries(spark, f"{tmp_dir}/summ").collect()}
    rows = oe.summarize_entities(oe.dedup_entities(oe.extract_entities(pages, clean=True)))
    assert got == {r["doc_id"]: r["entity_summary"] for r in rows.collect()}
