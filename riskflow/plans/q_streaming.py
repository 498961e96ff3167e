"""Registered queries: Structured Streaming runs over the event table (O-R2, O-R3, O-R5).

Each runs a file-source stream over ``events.parquet`` to completion
(``availableNow``) into a Parquet sink under the shared checkpoint folder and
returns what the sink holds.  In append mode a window is emitted once the
watermark (newest event time minus the delay) has passed its end, so the
oracle keeps exactly the windows that closed.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import monitor as om
from ..operators.assemble import linear_scorer
from ..session import checkpoint_dir
from ..streaming import stateful as ss
from ..streaming import streams as st
from . import sql_views as sv
from . import views
from .q_assemble import _LINEAR_ROWS, SUB_LABELS
from .q_entities import DEDUP_CTE, ENTITIES_CTE, LISTS_CTE, SUMMARY_LONG_CTE
from .q_quality import LINEAR_MODEL, SEVERITY_MODEL
from .registry import register
from .. import vocab

C = sv.with_ctes
DELAY = "10 minutes"
HOURS, IDLE_MS = 40, 1_830_500  # hours over which the pages arrive; idle time that closes a document


def _events_stream(spark, sf_dir):
    return st.read_table_stream(spark, sf_dir, "events.parquet")


@register(
    "stream_error_rate",
    C(sv.REQUESTS) + """, errs AS (
  SELECT time_bucket(INTERVAL '5 minutes', ts) AS ws, service, CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS errors,
    round(count(*) FILTER (WHERE is_error) / count(*) * 100.0, 6) AS error_pct FROM requests GROUP BY ALL)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, service, n, errors, error_pct FROM errs
WHERE ws + INTERVAL '5 minutes' <= (SELECT max(ts) FROM requests) - INTERVAL '10 minutes'""",
)
def stream_error_rate(spark, sf_dir):
    """O-R2: 5-minute error share per service on a watermarked event stream."""
    ev = st.with_event_time(views.requests_from(_events_stream(spark, sf_dir)), "ts", DELAY)
    out = st.run_to_table(st.stream_error_rate(ev, "service", "5 minutes"), "stream_error_rate")
    return out.withColumn("window_start", F.date_format("window_start", om.TS_FORMAT))


@register(
    "stream_alerts",
    C(sv.REQUESTS) + """, errs AS (
  SELECT time_bucket(INTERVAL '5 minutes', ts) AS ws, service, CAST(count(*) AS BIGINT) AS n,
    CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS errors,
    round(count(*) FILTER (WHERE is_error) / count(*) * 100.0, 6) AS error_pct FROM requests GROUP BY ALL)
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, service, n, errors, error_pct FROM errs
WHERE ws + INTERVAL '5 minutes' <= (SELECT max(ts) FROM requests) - INTERVAL '10 minutes' AND error_pct >= 5.0""",
)
def stream_alerts(spark, sf_dir):
    """O-R5: the red-threshold alerts on the stream."""
    ev = st.with_event_time(views.requests_from(_events_stream(spark, sf_dir)), "ts", DELAY)
    out = st.run_to_table(st.stream_alerts(st.stream_error_rate(ev, "service", "5 minutes"), 5.0), "stream_alerts")
    return out.withColumn("window_start", F.date_format("window_start", om.TS_FORMAT))


@register(
    "stream_dedup",
    """SELECT event_type, count(*) AS n, count(DISTINCT event_id) AS n_distinct,
  CAST(count(*) + count(*) FILTER (WHERE event_id % 10 = 0) + count(*) FILTER (WHERE event_id % 15 = 0) AS BIGINT) AS n_fed
FROM events GROUP BY event_type""",
)
def stream_dedup(spark, sf_dir):
    """O-R3: request ids repeated within the watermark delay are dropped: the
    events, every 10th again two minutes later and every 15th again four later."""

    def fed(e):
        e = e.select("event_id", "event_type", F.col("ts").cast("timestamp").alias("ts"))
        for every, minutes in ((10, 2), (15, 4)):
            late = e.where(F.col("event_id") % every == 0).withColumn("ts", F.col("ts") + F.expr(f"INTERVAL {minutes} MINUTES"))
            yield late
        yield e

    ten, fifteen, all_ = fed(_events_stream(spark, sf_dir))
    ev = st.dedup_stream(all_.unionByName(ten).unionByName(fifteen), "event_id", "ts", DELAY)
    out = st.run_to_table(ev.select("event_id", "event_type"), "stream_dedup")
    batch = list(fed(views.table(spark, sf_dir, "events")))
    total = batch[2].unionByName(batch[0]).unionByName(batch[1]).groupBy("event_type").agg(F.count(F.lit(1)).alias("n_fed"))
    return out.groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_distinct")
    ).join(total, "event_type")


@register(
    "stream_submissions",
    C(sv.SUBMISSION_PAGES, ENTITIES_CTE, DEDUP_CTE, SUMMARY_LONG_CTE, LISTS_CTE) + f""",
feats AS (SELECT doc_id, {sv.features({lab: f"l_{lab.lower()}" for lab in SUB_LABELS}, "total")} FROM doc_lists),
terms(feature, i, beta, mean, amount) AS (VALUES {_LINEAR_ROWS}),
sums AS (SELECT doc_id, 1 / (1 + exp(-({LINEAR_MODEL.intercept} + sum(beta * (value - mean) ORDER BY i)))) AS p,
    {SEVERITY_MODEL.intercept} + sum(amount * (value - mean) ORDER BY i) AS amount
  FROM (UNPIVOT feats ON {", ".join(vocab.FEATURE_NAMES)} INTO NAME feature VALUE value) JOIN terms USING (feature) GROUP BY doc_id),
arrived AS (SELECT doc_id, (doc_id % {HOURS}) * 3600 + page_number * 180 AS second FROM submission_pages),
closed AS (SELECT doc_id, CAST(count(*) AS BIGINT) AS page_count FROM arrived GROUP BY 1
  HAVING max(second) + {IDLE_MS / 1000} <= (SELECT max(second) FROM arrived) - 600)
SELECT doc_id, page_count, CASE WHEN p < 0.25 THEN 'LOW' WHEN p < 0.5 THEN 'MODERATE' WHEN p < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_tier,
  round(p, 4) AS risk_probability, round(greatest(amount, 0.0), 2) AS predicted_claim_amount, round(abs(p - 0.5) * 2.0, 4) AS confidence_score
FROM sums JOIN closed USING (doc_id)""",
)
def stream_submissions(spark, sf_dir):
    """O-R1: pages on the stream, arriving three times, cut through documents (each
    arrival is any number of files, read as one micro-batch by the stream as it goes on):
    held as state until no page of the document came for half an hour, then its
    features and fitted scores; documents still open at the end are not due."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/stream-submissions-{uuid.uuid4().hex[:12]}"
    second = (F.col("doc_id") % HOURS) * 3600 + F.col("page_number") * 180
    pages = views.submission_pages(spark, sf_dir).withColumn("ts", F.timestamp_seconds(second + 1_704_067_200))
    cuts = [None, HOURS // 3 * 3600 + 400, HOURS * 2 // 3 * 3600 + 400, None]
    ss.use_rocksdb(spark)
    for low, high in zip(cuts, cuts[1:]):
        part = pages if low is None else pages.where(second >= low)
        (part if high is None else part.where(second < high)).write.mode("append").parquet(f"{base}/pages")
        stream = st.read_table_stream(spark, f"{base}/pages", "*.parquet")
        closed = ss.stream_assess(stream, linear_scorer(LINEAR_MODEL, SEVERITY_MODEL), delay=DELAY, idle_ms=IDLE_MS)
        (closed.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/checkpoint")
         .trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(closed.schema).parquet(f"{base}/out")


@register(
    "stream_request_rate",
    C(sv.REQUESTS) + """, wide AS (
  SELECT time_bucket(INTERVAL '5 minutes', ts) - k * INTERVAL '5 minutes' AS ws, service FROM requests, (VALUES (0), (1)) t(k))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, service, CAST(count(*) AS BIGINT) AS n, round(count(*) / 600.0, 6) AS rate_per_s
FROM wide GROUP BY ws, service HAVING ws + INTERVAL '10 minutes' <= (SELECT max(ts) FROM requests) - INTERVAL '10 minutes'""",
)
def stream_request_rate(spark, sf_dir):
    """O-R2: requests per second and service over 10-minute windows every 5 minutes."""
    ev = st.with_event_time(views.requests_from(_events_stream(spark, sf_dir)), "ts", DELAY)
    out = st.run_to_table(st.stream_request_rate(ev, "service", "10 minutes", "5 minutes"), "stream_request_rate")
    return out.withColumn("window_start", F.date_format("window_start", om.TS_FORMAT))


LIMIT = 4  # requests of one client in a window; about 2 is usual in the events table


@register(
    "stream_over_limit",
    C(sv.REQUESTS) + f""", wide AS (
  SELECT time_bucket(INTERVAL '1 hour', ts) - k * INTERVAL '1 hour' AS ws, client FROM requests, range(24) t(k))
SELECT strftime(ws, '%Y-%m-%d %H:%M:%S') AS window_start, client, CAST(count(*) AS BIGINT) AS n FROM wide GROUP BY ws, client
HAVING count(*) > {LIMIT} AND ws + INTERVAL '24 hours' <= (SELECT max(ts) FROM requests) - INTERVAL '10 minutes'""",
)
def stream_over_limit(spark, sf_dir):
    """O-R2: clients with more than LIMIT requests in any 24 hours, every hour:
    hourly counts chained into sliding windows on one watermarked stream."""
    ev = st.with_event_time(views.requests_from(_events_stream(spark, sf_dir)), "ts", DELAY)
    out = st.run_to_table(st.stream_over_limit(ev, "client", LIMIT, "24 hours", "1 hour"), "stream_over_limit")
    return out.withColumn("window_start", F.date_format("window_start", om.TS_FORMAT))


@register(
    "stream_request_trace",
    C(sv.REQUESTS) + """, s AS (SELECT event_id // 2 AS request_id, ts FROM requests WHERE event_id % 2 = 0),
c AS (SELECT event_id // 2 AS request_id, ts FROM requests WHERE event_id % 2 = 1),
passed AS (SELECT least((SELECT max(ts) FROM s), (SELECT max(ts) FROM c)) - INTERVAL '10 minutes' AS w)
SELECT s.request_id, (epoch_us(c.ts) - epoch_us(s.ts)) / 1000.0 AS duration_ms, c.ts IS NOT NULL AS complete
FROM s LEFT JOIN c ON c.request_id = s.request_id AND c.ts >= s.ts AND c.ts <= s.ts + INTERVAL '30 minutes', passed
WHERE c.ts IS NOT NULL OR s.ts + INTERVAL '30 minutes' < w""",
)
def stream_request_trace(spark, sf_dir):
    """O-A9 on the stream: starts (even event ids) joined with completions (odd
    ones) within 30 minutes; starts whose time has passed come without one."""

    def side(odd):
        r = views.requests_from(_events_stream(spark, sf_dir)).where(F.col("event_id") % 2 == odd)
        return r.select(F.floor(F.col("event_id") / 2).cast("bigint").alias("request_id"), "ts")

    return st.run_to_table(st.stream_request_trace(side(0), side(1), delay=DELAY), "stream_request_trace")
