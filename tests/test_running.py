"""Running totals and row numbers against a plain loop."""

import itertools
import random

import pytest
from pyspark.sql import functions as F

from riskflow.operators.running import row_numbers, running_total


def plain(rows, by, order, value):
    """{row: running sum} of distinct rows, the slow way."""
    out = {}
    key = lambda r: tuple((r[b] is not None, r[b] or "") for b in by)
    for _, group in itertools.groupby(sorted(rows, key=lambda r: (key(r), r[order])), key=key):
        total = 0
        for r in group:
            total += value(r)
            out[tuple(r.values())] = total
    return out


def sample(n=3000):
    rng = random.Random(3)
    group = lambda i: "hot" if i % 3 == 0 else rng.choice([None, "", "a", "b", "longer key", f"k{i % 400}"])
    return [{"g": group(i), "id": f"id-{rng.randrange(10**12):013d}-{i}", "v": rng.choice([None, 0, 1, 7])} for i in range(n)]


@pytest.mark.parametrize("partitions", [1, 7, 64])
def test_running_total_equals_plain_loop(spark, partitions):
    rows = sample()
    df = spark.createDataFrame(rows, "g string, id string, v int")
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = running_total(df, ["id"], ["g"], F.col("v"), "total").collect()
        numbered = row_numbers(df, ["id"], out="n", start=0).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    want = plain(rows, ["g"], "id", lambda r: r["v"] or 0)
    assert {(r.g, r.id, r.v): r.total for r in got} == want and len(got) == len(rows)
    order = {r: i for i, r in enumerate(sorted(x["id"] for x in rows))}
    assert all(r.n == order[r.id] for r in numbered) and len(numbered) == len(rows)


def test_group_with_a_third_of_the_rows_spreads(spark):
    df = spark.createDataFrame(sample(), "g string, id string, v int")
    dealt = df.repartitionByRange(16, "g", "id").where("g = 'hot'").groupBy(F.spark_partition_id()).count().collect()
    assert len(dealt) > 3


def test_equal_rows_and_doubles(spark):
    df = spark.createDataFrame([(1, 0.5)] * 500 + [(None, 0.25)] * 3, "g int, x double")
    got = running_total(df, ["x"], ["g"], F.col("x"), "s").collect()
    assert sorted(r.s for r in got if r.g == 1) == [0.5 * (i + 1) for i in range(500)]
    assert sorted(r.s for r in got if r.g is None) == [0.25, 0.5, 0.75]


def test_empty_table_and_clashing_names(spark):
    empty = spark.createDataFrame([], "g string, id string")
    assert row_numbers(empty, ["id"], ["g"]).collect() == []
    odd = spark.createDataFrame([("a", 1, 2)], "g string, __pid int, __local int")
    assert [tuple(r) for r in row_numbers(odd, ["__pid"], ["g"], out="n").collect()] == [("a", 1, 2, 1)]
    with pytest.raises(ValueError):
        row_numbers(odd, ["g"], out="G")
