"""O-A1..O-A10: monitoring aggregates over request / audit events.

All are grouped aggregates with map-side combine (a hot service or client
collapses to one partial row per map task), or a bounded table (histogram
buckets).  The same functions run on a streaming DataFrame after
``withWatermark`` (see ``riskflow.streaming``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..session import staged

TS_FORMAT = "yyyy-MM-dd HH:mm:ss"


def _window(ts: str, duration: str, slide: str | None):
    return F.window(ts, duration, slide) if slide else F.window(ts, duration)


def _seconds(duration: str) -> int:
    n, unit = duration.split()
    return int(n) * {"second": 1, "seconds": 1, "minute": 60, "minutes": 60, "hour": 3600, "hours": 3600,
                     "day": 86400, "days": 86400}[unit]


def request_rate(events: DataFrame, key: str = "service", duration: str = "5 minutes", slide: str | None = None,
                 ts: str = "ts") -> DataFrame:
    """O-A1: requests per second per key over (tumbling or sliding) windows."""
    secs = _seconds(duration)
    return events.groupBy(_window(ts, duration, slide).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(
        F.col("w.start").alias("window_start"), key, F.col("n").cast("bigint").alias("n"),
        F.round(F.col("n") / float(secs), 6).alias("rate_per_s"),
    )


def error_rate(events: DataFrame, key: str = "service", duration: str = "5 minutes", slide: str | None = None,
               ts: str = "ts", error: str = "is_error") -> DataFrame:
    """O-A2: share of 5xx responses (percent) per key and window."""
    return events.groupBy(_window(ts, duration, slide).alias("w"), key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(error)).alias("errors")
    ).select(
        F.col("w.start").alias("window_start"), key, F.col("n").cast("bigint").alias("n"),
        F.col("errors").cast("bigint").alias("errors"),
        F.round(F.col("errors") / F.col("n") * 100.0, 6).alias("error_pct"),
    )


def alerts(rates: DataFrame, threshold_pct: float = 5.0) -> DataFrame:
    """O-R5: windows whose error rate reaches the red threshold."""
    return rates.where(F.col("error_pct") >= threshold_pct)


#: Bits of a value fixed by each pass of the exact selection, from the top.
RADIX_SHIFTS = (52, 39, 26, 13, 0)
MOST_KEYS = 100_000  # whose ranks are broadcast; more are joined


def _flipped(bits: Column) -> Column:
    """Bits of a double <-> a long in the order of its value."""
    return F.when(bits < 0, bits.bitwiseXOR(F.lit(2**63 - 1))).otherwise(bits)


def _ordered_bits(values: Column) -> Column:
    """long: the bits of a double, in the order of its value (-0.0 is 0.0; NaN
    comes last)."""
    bits = F.java_method(F.lit("java.lang.Double"), F.lit("doubleToLongBits"), values + F.lit(0.0))
    return _flipped(bits.cast("long"))


def _value_of(bits: Column) -> Column:
    return F.java_method(F.lit("java.lang.Double"), F.lit("longBitsToDouble"), _flipped(bits)).cast("double")


def order_statistics(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """(_k, _t, value): the value at each 0-based ``_rank`` among the values of
    its key.  ``rows``: _k, _v (double, not null); ``targets``: _k, _t, _rank.

    A radix selection over the order-preserving bits: every pass counts, for each
    target, the next 13 bits of the values that share the bits found so far, so a
    pass makes at most 8,192 rows a target and there are always five, whatever
    the values and however many a key has.  No values are sorted or gathered."""
    bits = staged(rows.select("_k", _ordered_bits(F.col("_v")).alias("_bits")), "ordered-bits")
    found = staged(targets.select("_k", "_t", "_rank", F.lit(0).cast("long").alias("_at")), "ranks")
    few = found.count() <= MOST_KEYS * 2  # the size check of the broadcasts below
    before = None
    for shift in RADIX_SHIFTS:
        asked = found if before is None else found.withColumn("_same", F.col("_at"))
        asked = F.broadcast(asked) if few else asked
        at = F.shiftright("_bits", shift)
        if before is None:
            held = bits.join(asked.select("_k", "_t"), "_k")
        else:
            held = bits.withColumn("_same", F.shiftright("_bits", before)).join(asked.select("_k", "_t", "_same"), ["_k", "_same"])
        counts = held.groupBy("_k", "_t", at.alias("_next")).agg(F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_n").over(Window.partitionBy("_k", "_t").orderBy("_next"))  # of 8,192 rows at most
        met = counts.withColumn("_upto", upto).join(found.select("_k", "_t", "_rank"), ["_k", "_t"]).where("_upto > _rank")
        step = met.groupBy("_k", "_t").agg(F.min_by(F.struct("_next", (F.col("_rank") - F.col("_upto") + F.col("_n")).alias("_rank")), F.col("_next")).alias("_s"))
        found = staged(step.select("_k", "_t", F.col("_s._rank").alias("_rank"), F.col("_s._next").alias("_at")), "ranks")
        before = shift
    return found.select("_k", "_t", _value_of(F.col("_at")).alias("value"))


def latency_quantile(events: DataFrame, q: float = 0.99, key: str = "service", value: str = "latency",
                     exact: bool = True, accuracy: int = 10000) -> DataFrame:
    """O-A3: per-key latency quantile, with linear interpolation between the two
    order statistics around rank q * (n - 1); null values are left out.

    ``exact`` selects the two by radix (``order_statistics``); ``exact=False``
    answers with a bounded sketch."""
    name = f"p{int(round(q * 100))}"
    if not exact:
        return events.groupBy(key).agg(F.round(F.percentile_approx(F.col(value), q, accuracy), 6).alias(name),
                                       F.count(F.lit(1)).cast("bigint").alias("n"))
    # a struct as the key: a null key is a key like any other
    rows = events.select(F.struct(F.col(key).alias("key")).alias("_k"), F.col(value).cast("double").alias("_v"))
    ends = staged(rows.groupBy("_k").agg(F.count(F.lit(1)).alias("n"), F.count("_v").alias("_m")), "key-sizes")
    rank = F.lit(q) * (F.col("_m") - 1)
    targets = ends.where("_m > 0").select("_k", F.explode(F.array(
        F.struct(F.lit("low").alias("_t"), F.floor(rank).cast("long").alias("_rank")),
        F.struct(F.lit("high").alias("_t"), F.ceil(rank).cast("long").alias("_rank")))).alias("t")).select("_k", "t.*")
    got = order_statistics(rows.where("_v is not null"), targets).groupBy("_k").agg(
        F.max(F.when(F.col("_t") == "low", F.col("value"))).alias("_a"), F.max(F.when(F.col("_t") == "high", F.col("value"))).alias("_b"))
    part = rank - F.floor(rank)
    return ends.join(got, "_k", "left").select(
        F.col("_k.key").alias(key), F.round(F.when(part == 0, F.col("_a")).otherwise(F.col("_a") + (F.col("_b") - F.col("_a")) * part), 6).alias(name),
        F.col("n").cast("bigint").alias("n"))


def bucket_histogram(df: DataFrame, value: str, edges=tuple(vocab.SIMILARITY_BUCKETS), by: list[str] | None = None
                     ) -> DataFrame:
    """O-A6: cumulative ``le`` buckets.  Each value gets the index of the
    first edge >= value (an in-row search over the literal edge list), counts
    are aggregated per index, and the running sum runs over that bounded
    table (len(edges) rows per group)."""
    by = by or []
    edge_arr = F.array(*[F.lit(float(e)) for e in edges])
    idx = F.array_position(F.transform(edge_arr, lambda e: F.col(value) <= e), True)
    counts = df.where(F.col(value).isNotNull()).groupBy(*by, idx.alias("_i")).agg(F.count(F.lit(1)).alias("_n"))
    grid = F.array(*[F.struct(F.lit(i + 1).alias("_i"), F.lit(float(e)).alias("le")) for i, e in enumerate(edges)])
    # every bucket row per group, generated in-row from the literal edge list
    base = counts.select(*by).distinct() if by else df.sparkSession.range(1)
    full = base.select(*by, F.inline(grid))
    filled = full.join(counts, [*by, "_i"], "left").fillna(0, subset=["_n"])
    w = Window.partitionBy(*by).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0) if by else \
        Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    return filled.select(*by, "_i", "le", F.sum("_n").over(w).cast("bigint").alias("cumulative"))


def histogram_quantile(hist: DataFrame, q: float, by: list[str] | None = None) -> DataFrame:
    """O-A6: quantile from cumulative buckets by linear interpolation inside
    the bucket that holds rank q * total (lower bound 0 for the first bucket;
    the +Inf bucket answers with the largest finite edge)."""
    by = by or []
    w = Window.partitionBy(*by).orderBy("_i") if by else Window.orderBy("_i")
    h = hist.withColumn("_prev_le", F.lag("le", 1, 0.0).over(w)).withColumn(
        "_prev_c", F.lag("cumulative", 1, 0).over(w)
    )
    total = F.max("cumulative").over(Window.partitionBy(*by)) if by else F.max("cumulative").over(Window.partitionBy())
    h = h.withColumn("_total", total).withColumn("_rank", F.lit(q) * F.col("_total"))
    hit = h.where(F.col("cumulative") >= F.col("_rank")).groupBy(*by).agg(
        F.min_by(F.struct("le", "_prev_le", "_prev_c", "cumulative", "_rank", "_total"), F.col("_i")).alias("b")
    )
    b = F.col("b")
    interp = b["_prev_le"] + (b["le"] - b["_prev_le"]) * (b["_rank"] - b["_prev_c"]) / (
        b["cumulative"] - b["_prev_c"])
    value = F.when(b["_total"] == 0, F.lit(None)).when(F.isnan(b["le"]) | (b["le"] == float("inf")), b["_prev_le"]) \
        .when(b["cumulative"] == b["_prev_c"], b["le"]).otherwise(interp)
    return hit.select(*by, F.lit(q).alias("q"), F.round(value, 6).alias("value"))


def over_limit(events: DataFrame, key: str = "client", limit: int = 10, duration: str = "1 minute",
               ts: str = "ts", by: list[str] | None = None) -> DataFrame:
    """O-A8: tumbling windows in which a client sent more than ``limit`` requests."""
    by = by or []
    return (
        events.groupBy(F.window(ts, duration).alias("w"), key, *by)
        .agg(F.count(F.lit(1)).alias("n"))
        .where(F.col("n") > limit)
        .select(F.col("w.start").alias("window_start"), key, *by, F.col("n").cast("bigint").alias("n"))
    )


def request_durations(events: DataFrame, correlation: str = "request_id", phase: str = "phase",
                      ts: str = "ts") -> DataFrame:
    """O-A9: started/completed pairs -> duration (ms) per correlation id (one
    aggregate; ids missing a side are kept with a null duration)."""
    started = F.min(F.when(F.col(phase) == "started", F.col(ts)))
    done = F.max(F.when(F.col(phase) == "completed", F.col(ts)))
    return events.groupBy(correlation).agg(started.alias("_s"), done.alias("_d")).select(
        correlation,
        ((F.unix_micros("_d") - F.unix_micros("_s")) / 1000.0).alias("duration_ms"),
        (F.col("_s").isNotNull() & F.col("_d").isNotNull()).alias("complete"),
    )


def audit_summary(audit: DataFrame) -> DataFrame:
    """O-A10: audit events by tier and provider."""
    return audit.groupBy("risk_tier", "provider").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"),
        F.round(F.avg("risk_probability"), 6).alias("mean_probability"),
        F.round(F.avg("processing_time_ms"), 6).alias("mean_processing_ms"),
        F.round(F.coalesce(F.avg(F.col("hallucination_detected").cast("double")), F.lit(0.0)), 6).alias(
            "detection_share"),
    )
