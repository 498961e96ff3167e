"""Judge replies, grounding, audit, fallback and evaluation golden values."""

import json

import pytest
from pyspark.sql import functions as F

from riskflow.operators import assemble as oa
from riskflow.operators import evaluate as oe
from riskflow.operators import quality as oq


@pytest.mark.parametrize("reply,expected", [
    ('{"hallucination_detected": false, "hallucination_count": 0, "details": [], "confidence": 0.9}',
     (False, 0, [], 0.9)),
    ('{"hallucination_detected": true, "hallucination_count": 2, "details": ["a", "b"], "confidence": 0.8}',
     (True, 2, ["a", "b"], 0.8)),
    ("not valid json", (False, 0, [], 0.0)),
    ('{"hallucination_detected": true, "hallucination_count": 1, "details": [], "confidence": 1.5}',
     (False, 0, [], 0.0)),
    (None, (False, 0, [], 0.0)),
])
def test_parse_judgement(spark, reply, expected):
    r = spark.createDataFrame([(reply,)], "r string").select(oq.parse_judgement(F.col("r")).alias("j")).first()["j"]
    assert (r["detected"], r["count"], list(r["flags"]), r["confidence"]) == expected


def test_ungrounded_numbers(spark):
    df = spark.createDataFrame(
        [("Claim $48,500.00 and $99,999 expected; 78.0% likely; 12% loading; 55.5% odd", ["48500.00", "78.0"])],
        "n string, k array<string>",
    )
    issues = df.select(oq.ungrounded_issues(F.col("n"), F.col("k")).alias("i")).first()["i"]
    assert issues == ["Ungrounded amount: $99,999", "Ungrounded percentage: 55.5%"]


def test_within_one_percent_is_grounded(spark):
    df = spark.createDataFrame([("cost $100.50", ["100"])], "n string, k array<string>")
    assert df.select(oq.ungrounded_issues(F.col("n"), F.col("k"))).first()[0] == []


def test_fallback_prediction(spark):
    subs = spark.createDataFrame([(1,), (2,)], "submission_id bigint")
    pred = spark.createDataFrame([(1, "HIGH", 0.7, 100.0, 0.4)],
                                 "submission_id bigint, risk_tier string, risk_probability double, "
                                 "predicted_claim_amount double, confidence_score double")
    rows = {r["submission_id"]: r for r in oa.assemble_analysis(subs, pred).collect()}
    assert rows[2]["risk_tier"] == "MODERATE" and rows[2]["risk_probability"] == 0.5
    assert rows[2]["confidence_score"] == 0.5 and rows[2]["is_fallback"] and rows[2]["similar_cases"] == []
    assert rows[1]["risk_tier"] == "HIGH" and not rows[1]["is_fallback"]


def test_audit_append_twice(spark, tmp_dir):
    a = spark.createDataFrame(
        [("audit-001", "HIGH", 0.78, 48500.0, 0.56, 321.5)],
        "submission_id string, risk_tier string, risk_probability double, predicted_claim_amount double, "
        "confidence_score double, processing_time_ms double",
    ).withColumn("similar_cases", F.array().cast(oa.CASE_TYPE)).withColumn(
        "hallucination_check", F.lit(None).cast(oa.CHECK_TYPE))
    ev = oa.audit_events(a, "hosted")
    oa.write_audit(ev, f"{tmp_dir}/audit")
    oa.write_audit(ev, f"{tmp_dir}/audit")
    back = spark.read.json(f"{tmp_dir}/audit").collect()
    assert len(back) == 2 and back[0]["risk_tier"] == "HIGH" and back[0]["similar_cases_count"] == 0
    assert len(ev.columns) == 12


# The published 20-case evaluation: (expected tier, predicted tier, probability,
# predicted amount, actual amount, top similarity, time ms, incident type).
GOLDEN_CASES = [
    ("LOW", "LOW", 0.1285, 13983.24, 2860.0, 0.8688, 86.1, "Parked Car"),
    ("LOW", "LOW", 0.1904, 13042.6, 6100.0, 0.8689, 21.1, "Vehicle Theft"),
    ("LOW", "LOW", 0.1278, 10280.87, 7080.0, 0.8783, 24.2, "Vehicle Theft"),
    ("LOW", "LOW", 0.1218, 10463.8, 7260.0, 0.8803, 19.0, "Vehicle Theft"),
    ("LOW", "LOW", 0.1254, 5173.96, 100.0, 0.8351, 20.9, "Parked Car"),
    ("MODERATE", "LOW", 0.2352, 13618.48, 4700.0, 0.8861, 22.4, "Parked Car"),
    ("MODERATE", "HIGH", 0.71, 40257.13, 7080.0, 0.8913, 28.2, "Vehicle Theft"),
    ("MODERATE", "LOW", 0.0492, 32192.27, 33480.0, 0.8727, 9.8, "Single Vehicle Collision"),
    ("MODERATE", "LOW", 0.1439, 8598.87, 6820.0, 0.899, 9.1, "Vehicle Theft"),
    ("MODERATE", "MODERATE", 0.3372, 53400.7, 52290.0, 0.8911, 11.1, "Multi-vehicle Collision"),
    ("HIGH", "CRITICAL", 0.8029, 38632.21, 35300.0, 0.8564, 25.4, "Multi-vehicle Collision"),
    ("HIGH", "CRITICAL", 0.8392, 73469.6, 70900.0, 0.856, 19.7, "Single Vehicle Collision"),
    ("HIGH", "CRITICAL", 0.9667, 77234.98, 79090.0, 0.8665, 28.5, "Multi-vehicle Collision"),
    ("HIGH", "HIGH", 0.7274, 82991.45, 95000.0, 0.8901, 9.3, "Single Vehicle Collision"),
    ("HIGH", "MODERATE", 0.4491, 69272.61, 52560.0, 0.8851, 31.3, "Multi-vehicle Collision"),
    ("CRITICAL", "CRITICAL", 0.8234, 40538.76, 46200.0, 0.8685, 9.9, "Single Vehicle Collision"),
    ("CRITICAL", "CRITICAL", 0.8603, 52191.74, 51480.0, 0.8993, 11.2, "Multi-vehicle Collision"),
    ("CRITICAL", "HIGH", 0.5894, 68868.23, 69700.0, 0.9216, 21.9, "Single Vehicle Collision"),
    ("CRITICAL", "CRITICAL", 0.8387, 63870.73, 62800.0, 0.8874, 22.6, "Multi-vehicle Collision"),
    ("CRITICAL", "CRITICAL", 0.8791, 57238.75, 54340.0, 0.8875, 10.9, "Multi-vehicle Collision"),
]


def test_golden_eval_report(spark):
    rows = []
    for i, (exp, pred, p, amt, act, sim, ms, itype) in enumerate(GOLDEN_CASES):
        rows.append((i, exp, pred, p, amt, act, sim, ms, itype))
    df = spark.createDataFrame(rows, "case_index int, expected_tier string, predicted_tier string, "
                                     "risk_probability double, predicted_claim_amount double, actual double, "
                                     "rag_top_similarity double, processing_time_ms double, incident_type string")
    res = df.select(
        "*",
        (F.col("expected_tier") == F.col("predicted_tier")).alias("tier_match"),
        oe.tier_adjacent(F.col("expected_tier"), F.col("predicted_tier")).alias("tier_adjacent"),
        oe.claim_reasonable(F.col("predicted_claim_amount"), F.col("actual")).alias("claim_reasonable"),
        F.lit(True).alias("consistency_passed"), F.lit(True).alias("shap_grounded"),
        F.lit(True).alias("rag_type_match"), F.lit(5).alias("rag_result_count"),
    )
    m = oe.eval_metrics(res).first()
    assert (m["tier_exact_match"], m["tier_adjacent_match"], m["consistency_passed"], m["shap_grounded"]) == (11, 20, 20, 20)
    assert m["mean_rag_similarity"] == 0.8795 and m["mean_processing_time_ms"] == 22.1
    assert m["claim_reasonable"] == 19
    conf = {(r["expected_tier"], r["predicted_tier"]): r["n"] for r in oe.confusion(res).collect()}
    assert conf == {("LOW", "LOW"): 5, ("MODERATE", "LOW"): 3, ("MODERATE", "MODERATE"): 1,
                    ("MODERATE", "HIGH"): 1, ("HIGH", "MODERATE"): 1, ("HIGH", "HIGH"): 1,
                    ("HIGH", "CRITICAL"): 3, ("CRITICAL", "HIGH"): 1, ("CRITICAL", "CRITICAL"): 4}


def test_tier_adjacency_unknown(spark):
    df = spark.createDataFrame([("X", "Y"), ("X", "LOW"), ("X", "MODERATE")], "e string, p string")
    got = [r[0] for r in df.select(oe.tier_adjacent(F.col("e"), F.col("p"))).collect()]
    assert got == [True, True, False]
