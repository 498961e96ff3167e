"""Registered queries: monitoring aggregates (O-A*) and alerts (O-R5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import explain as ox
from ..operators import monitor as om
from ..session import staged
from . import sql_views as sv
from . import views
from .registry import register

C = sv.with_ctes
FMT = om.TS_FORMAT


def _fmt(df, col="window_start"):
    return df.withColumn(col, F.date_format(col, FMT))


WINDOW_SQL = "strftime(time_bucket(INTERVAL '5 minutes', ts), '%Y-%m-%d %H:%M:%S')"


@register(
    "request_rate",
    C(sv.REQUESTS) + f"""SELECT {WINDOW_SQL} AS window_start, service, CAST(count(*) AS BIGINT) AS n,
  round(count(*) / 300.0, 6) AS rate_per_s FROM requests GROUP BY ALL""",
)
def request_rate(spark, sf_dir):
    """O-A1: requests per second per service over 5-minute windows."""
    return _fmt(om.request_rate(views.requests(spark, sf_dir), "service", "5 minutes"))


ERROR_SQL = f"""errs AS (SELECT {WINDOW_SQL} AS window_start, service, CAST(count(*) AS BIGINT) AS n,
  CAST(count(*) FILTER (WHERE is_error) AS BIGINT) AS errors,
  round(count(*) FILTER (WHERE is_error) / count(*) * 100.0, 6) AS error_pct FROM requests GROUP BY ALL)"""


@register("error_rate", C(sv.REQUESTS, ERROR_SQL) + "SELECT * FROM errs")
def error_rate(spark, sf_dir):
    """O-A2: 5xx share per service and 5-minute window."""
    return _fmt(om.error_rate(views.requests(spark, sf_dir), "service", "5 minutes"))


@register("alerts", C(sv.REQUESTS, ERROR_SQL) + "SELECT * FROM errs WHERE error_pct >= 5.0")
def alerts(spark, sf_dir):
    """O-R5 (batch form): windows at or above the red 5 % error threshold."""
    return _fmt(om.alerts(om.error_rate(views.requests(spark, sf_dir), "service", "5 minutes"), 5.0))


@register(
    "latency_p99",
    C(sv.REQUESTS) + """SELECT service, round(quantile_cont(latency, 0.99), 6) AS p99, CAST(count(*) AS BIGINT) AS n
FROM requests GROUP BY service""",
)
def latency_p99(spark, sf_dir):
    """O-A3: exact p99 latency per service."""
    return om.latency_quantile(views.requests(spark, sf_dir), 0.99, "service", "latency")


_EDGES = vocab.SIMILARITY_BUCKETS
_EDGE_CASE = "CASE " + " ".join(
    f"WHEN similarity_score <= {e} THEN {i + 1}" for i, e in enumerate(_EDGES[:-1])
) + f" ELSE {len(_EDGES)} END"
_GRID = " UNION ALL ".join(
    f"SELECT {i + 1} AS _i, {('CAST(' + repr('inf') + ' AS DOUBLE)') if e == float('inf') else repr(float(e))} AS le"
    for i, e in enumerate(_EDGES)
)
HIST_SQL = f"""hist AS (
  SELECT g._i, g.le, CAST(sum(coalesce(c.n, 0)) OVER (ORDER BY g._i) AS BIGINT) AS cumulative
  FROM ({_GRID}) g LEFT JOIN (
    SELECT {_EDGE_CASE} AS _i, count(*) AS n FROM neighbours WHERE similarity_score IS NOT NULL GROUP BY 1) c
  USING (_i))"""


def _similarities(spark, sf_dir):
    return views.neighbour_rows(spark, sf_dir).select("similarity_score")


@register(
    "similarity_histogram",
    C(sv.CLAIMS, sv.CLAIM_CASES, sv.NEIGHBOURS, HIST_SQL) + "SELECT _i, le, cumulative FROM hist",
)
def similarity_histogram(spark, sf_dir):
    """O-A6: cumulative ``le`` buckets of neighbour similarities."""
    return om.bucket_histogram(_similarities(spark, sf_dir), "similarity_score")


@register(
    "similarity_quantiles",
    C(sv.CLAIMS, sv.CLAIM_CASES, sv.NEIGHBOURS, HIST_SQL) + """, h AS (
  SELECT *, coalesce(lag(le) OVER (ORDER BY _i), 0.0) AS prev_le, coalesce(lag(cumulative) OVER (ORDER BY _i), 0) AS prev_c,
    max(cumulative) OVER () AS total FROM hist),
qs AS (SELECT unnest([0.5, 0.9, 0.99]) AS q),
hit AS (SELECT q, arg_min(h, h._i) AS b FROM qs, h WHERE h.cumulative >= q * h.total GROUP BY q)
SELECT CAST(q AS DOUBLE) AS q, round(CASE WHEN b.total = 0 THEN NULL WHEN isinf(b.le) THEN b.prev_le WHEN b.cumulative = b.prev_c THEN b.le
  ELSE b.prev_le + (b.le - b.prev_le) * (q * b.total - b.prev_c) / (b.cumulative - b.prev_c) END, 6) AS value
FROM hit""",
)
def similarity_quantiles(spark, sf_dir):
    """O-A6: p50/p90/p99 of neighbour similarity from the buckets."""
    # a row per bucket, used by three quantiles: computed once
    hist = staged(om.bucket_histogram(_similarities(spark, sf_dir), "similarity_score"), "similarity-buckets")
    out = None
    for q in (0.5, 0.9, 0.99):
        part = om.histogram_quantile(hist, q)
        out = part if out is None else out.unionByName(part)
    return out


@register(
    "embedding_hit_ratio",
    """SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT text) AS BIGINT) AS n_distinct,
  round(1 - count(DISTINCT text) / count(*), 6) AS repeat_ratio FROM documents""",
)
def embedding_hit_ratio(spark, sf_dir):
    """O-A7: share of embedding inputs that repeat an earlier text."""
    return ox.repeat_ratio(views.table(spark, sf_dir, "documents"), ["text"])


@register(
    "over_limit",
    C(sv.REQUESTS) + """SELECT strftime(time_bucket(INTERVAL '1 minute', ts), '%Y-%m-%d %H:%M:%S') AS window_start,
  client, CAST(count(*) AS BIGINT) AS n FROM requests GROUP BY ALL HAVING count(*) > 1""",
)
def over_limit(spark, sf_dir):
    """O-A8: client-minutes above the per-minute request limit (1 here)."""
    return _fmt(om.over_limit(views.requests(spark, sf_dir), "client", 1, "1 minute"))


@register(
    "request_trace",
    C(sv.REQUESTS) + """SELECT event_id // 2 AS request_id,
  (epoch_us(max(ts) FILTER (WHERE event_id % 2 = 1)) - epoch_us(min(ts) FILTER (WHERE event_id % 2 = 0))) / 1000.0 AS duration_ms,
  count(*) FILTER (WHERE event_id % 2 = 0) > 0 AND count(*) FILTER (WHERE event_id % 2 = 1) > 0 AS complete
FROM requests GROUP BY 1""",
)
def request_trace(spark, sf_dir):
    """O-A9: request start/complete pairs (even/odd event ids) -> duration."""
    r = views.requests(spark, sf_dir).select(
        (F.col("event_id") / 2).cast("bigint").alias("request_id"),
        F.when(F.col("event_id") % 2 == 0, F.lit("started")).otherwise(F.lit("completed")).alias("phase"),
        "ts",
    )
    return om.request_durations(r, "request_id", "phase", "ts")
