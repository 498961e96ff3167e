"""O-R1: documents assembled on the stream, with state per open document.

Pages arrive in any order and over many micro-batches.  A document is a session of
its pages under its key: its pages' entities are held as state until no page of it
has come for ``idle`` of event time; then its summary goes out, its state is
dropped, and the rest of the stream (features, fitted scores, tiers) is a narrow
projection.  State is therefore as large as the entities of the open documents.
Sessions are Spark's own state operator: no Python runs a document.

A page whose session would have closed behind the watermark (``delay`` behind the
newest) is late and left out; a page that comes ``idle`` or more of event time after
its document's others opens the document anew and yields a second row, whatever
micro-batches they came in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.core import let
from ..operators.entities import page_entities
from ..operators.features import features
from ..operators.scoring import score

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def use_rocksdb(spark: SparkSession) -> None:
    """Per-document state needs the RocksDB state store (its working files are
    local, its checkpoints go to the stream's checkpoint folder)."""
    spark.conf.set(STATE_STORE, ROCKSDB)


def merged(entries: list[tuple]) -> list[tuple]:
    """O-N4 in plain Python, which tests hold the stream against, on (lower text,
    label, text, confidence, page, span, first page, first span): one entry per
    lower text and label, the highest confidence and among those the first seen,
    with the place of the first of all."""
    best: dict[tuple, tuple] = {}
    for e in entries:
        old = best.get(e[:2])
        if old is None:
            best[e[:2]] = e
            continue
        kept = min(old, e, key=lambda x: (-x[3], x[4], x[5]))
        first = min(old[6:8], e[6:8])
        best[e[:2]] = (*kept[:6], *first)
    return list(best.values())


def summary_of(entries: list[tuple]) -> list[dict]:
    """O-N5: labels with their texts, both in the order they were first seen."""
    found: dict[str, list[str]] = {}
    for e in sorted(merged(entries), key=lambda x: (x[6], x[7], x[1], x[2])):
        found.setdefault(e[1], []).append(e[2])
    return [{"label": label, "values": values} for label, values in found.items()]


def _summary_entries(pages: Column) -> Column:
    """``summary_of`` in the document's row, of its gathered pages, whose finds are all
    of one confidence: sorted by lower text and label, the first seen of each stands
    in front of its repeats."""
    places = F.flatten(F.transform(pages, lambda p: F.transform(p["entities"], lambda e: F.struct(
        F.lower(e["text"]).alias("lower"), e["label"].alias("label"), p["page_number"].alias("page"),
        e["span_no"].alias("span"), e["text"].alias("text")))))

    def firsts(found: Column) -> Column:
        def new(e, i):
            last = F.get(found, i - 1)
            return (i == 0) | (e["lower"] != last["lower"]) | (e["label"] != last["label"])

        def place(e, i):
            return F.struct(e["page"].alias("page"), e["span"].alias("span"), e["label"].alias("label"), e["text"].alias("text"))

        return F.array_sort(F.transform(F.filter(found, new), place))

    def labelled(entries: Column) -> Column:
        labels = F.array_distinct(F.transform(entries, lambda e: e["label"]))
        return F.transform(labels, lambda lab: F.struct(
            lab.alias("label"), F.transform(F.filter(entries, lambda e: e["label"] == lab), lambda e: e["text"]).alias("values")))

    return let(F.array_sort(places), lambda found: let(firsts(found), labelled))


def stream_documents(pages: DataFrame, key: str = "doc_id", page: str = "page_number", text: str = "text", ts: str = "ts",
                     delay: str = "10 minutes", idle_ms: int = 600_000) -> DataFrame:
    """A page stream -> (key, page_count, entity_summary, summary_entries), one
    row per document once it has been idle for ``idle_ms`` of event time.

    A null or empty page counts as a page without entities; a page without a
    key belongs to the document of the null key; a page without event time is
    left out."""
    timed = pages.select(key, page, text, F.col(ts).cast("timestamp").alias(ts)).where(F.col(ts).isNotNull()).withWatermark(ts, delay)
    found = page_entities(timed, key, page, text, keep=[ts])
    open_for = F.session_window(ts, f"{idle_ms} milliseconds").alias("_open")
    closed = found.groupBy(key, open_for).agg(
        F.count(F.lit(1)).alias("page_count"), F.collect_list(F.struct("page_number", "entities")).alias("_pages"))
    closed = closed.select(key, "page_count", _summary_entries(F.col("_pages")).alias("summary_entries"))
    as_map = F.map_from_entries(F.transform("summary_entries", lambda e: F.struct(e["label"], e["values"])))
    return closed.select(key, "page_count", as_map.alias("entity_summary"), "summary_entries")


def stream_assess(pages: DataFrame, scorer, key: str = "doc_id", **options) -> DataFrame:
    """O-R1: pages in, fitted scores out: documents as they close -> the 28
    features -> ``scorer`` (``operators.assemble.linear_scorer`` or a fitted
    tree pipeline behind the same call) -> tier, amount and confidence."""
    closed = stream_documents(pages, key, **options)
    feats = features(closed, keep=[key, "page_count"])
    carried = score(scorer(feats, key, keep=["page_count"]))
    return carried.select(key, "page_count", "risk_tier", "risk_probability", "predicted_claim_amount", "confidence_score")
