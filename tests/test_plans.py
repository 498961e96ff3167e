"""Physical plan properties of the registered queries."""

import pytest
from pyspark.sql import functions as F

from riskflow.plans import registry

from .conftest import SF_SMALL

registry.load_all()
QUERIES = registry.QUERIES
NATIVE_ONLY = ["features_claims", "quality_checks", "request_rate", "error_rate", "latency_p99", "entities",
               "entity_summary", "top_factors", "chunk_text", "evaluate_cases", "assemble_analysis"]


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith("stream_")))
def test_no_cartesian_product(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


@pytest.mark.parametrize("name", NATIVE_ONLY)
def test_no_python_in_native_plans(spark, name):
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    for node in ("BatchEvalPython", "ArrowEvalPython", "MapInPandas", "FlatMapGroupsInPandas"):
        assert node not in plan, node


def test_pushdown_and_pruning(spark):
    from riskflow.plans import views

    plan = _plan(views.table(spark, SF_SMALL, "embeddings").where("vec_id < 20"))
    assert "PushedFilters: [IsNotNull(vec_id), LessThan(vec_id,20)]" in plan
    plan = _plan(QUERIES["score"](spark, SF_SMALL))
    # only the three columns the score needs are read (priority is pruned away)
    assert "ReadSchema: struct<o_orderkey:bigint,o_custkey:bigint,o_totalprice:double>" in plan


def test_nation_is_broadcast(spark):
    plan = _plan(QUERIES["claim_cases"](spark, SF_SMALL))
    assert "BroadcastHashJoin" in plan


def test_top_factors_stay_in_the_row(spark):
    plan = _plan(QUERIES["top_factors"](spark, SF_SMALL))
    assert "Exchange" not in plan and "Window" not in plan


def test_top_k_uses_group_limit(spark):
    plan = _plan(QUERIES["stratified_sample"](spark, SF_SMALL))
    assert "WindowGroupLimit" in plan


def test_distinct_inference_builds_the_features_once(spark):
    """Rows, distinct inputs and counts read what was written once, not the claims three times over."""
    plan = _plan(QUERIES["distinct_inference"](spark, SF_SMALL))
    assert "o_custkey" not in plan and "c_acctbal" not in plan


def test_a_quoted_number_is_parsed_once(spark):
    """Held against many known values, not parsed again for each."""
    from riskflow.operators.quality import ungrounded_issues

    df = spark.createDataFrame([("costs $1,234.50 or $99 and 45%", ["1234.50", "44.9"], [1234.5, 44.9])], "n string, k array<string>, v array<double>")
    out = df.select(ungrounded_issues(F.col("n"), F.col("k"), None, F.col("v")).alias("i"))
    assert out.first().i == ["Ungrounded amount: $99"]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    held = plan[plan.index("exists("):].split("0.99")[0]
    assert "regexp" not in held, held
