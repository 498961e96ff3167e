"""Exact quantiles against the engine's own percentile."""

import numpy as np
from pyspark.sql import functions as F

from riskflow.operators import monitor as om


def test_exact_quantile_matches_percentile(spark):
    rng = np.random.default_rng(1)
    rows = [("hot", float(x)) for x in rng.lognormal(size=20_000)] + [("ties", 5.0)] * 500 + [("ties", 7.0)] * 3
    rows += [("one", 2.5), ("two", 1.0), ("two", 2.0), ("none", None), ("one", None)]
    df = spark.createDataFrame(rows, "service string, latency double").repartition(5)
    for q in (0.0, 0.5, 0.99, 1.0):
        got = {r["service"]: (r[1], r["n"]) for r in om.latency_quantile(df, q).collect()}
        want = df.groupBy("service").agg(F.round(F.percentile("latency", F.lit(q)), 6).alias("p"), F.count(F.lit(1)).alias("n"))
        assert got == {r["service"]: (r["p"], r["n"]) for r in want.collect()}
    assert om.latency_quantile(df.where("false")).collect() == []


def test_radix_selection_with_one_key_and_odd_values(spark):
    """One service with all rows, ties, signs, tiny and infinite values: the
    order statistics are those of a sort."""
    import random

    import numpy as np

    rng = random.Random(8)
    values = [rng.choice([-1.5, 0.0, -0.0, 1e-310, 5e-324, 3.25, float("inf"), float("-inf"), rng.gauss(0, 1e6)]) for _ in range(4000)]
    rows = spark.createDataFrame([("s", v) for v in values] + [(None, 7.0)], "_k string, _v double")
    ranks = [0, 1, 17, 2000, 3998, 3999]
    targets = spark.createDataFrame([("s", str(r), r) for r in ranks], "_k string, _t string, _rank long")
    got = {int(r["_t"]): r["value"] for r in om.order_statistics(rows.where("_k is not null"), targets).collect()}
    want = np.sort(np.array(values))
    assert got == {r: want[r] for r in ranks}


def test_quantile_sorts_no_values(spark):
    df = spark.createDataFrame([("s", float(i)) for i in range(100)], "service string, latency double")
    plan = om.latency_quantile(df, 0.5)._jdf.queryExecution().executedPlan().toString()
    assert "Sort [_v" not in plan and "Sort [latency" not in plan


def test_null_key_is_a_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", None)], "service string, latency double")
    got = {r["service"]: (r["p50"], r["n"]) for r in om.latency_quantile(df, 0.5).collect()}
    assert got == {None: (2.0, 2), "a": (None, 1)}
