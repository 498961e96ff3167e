"""Feature, money and tier golden values (from the original test suite's examples)."""

import pytest
from pyspark.sql import functions as F

from riskflow import vocab
from riskflow.functions.features import feature_columns
from riskflow.functions.money import parse_money
from riskflow.operators.scoring import risk_tier, score

UNDERWRITING = {
    "PERSON": ["John Smith"],
    "MONEY": ["$50,000", "$500,000"],
    "PERIL": ["fire", "water damage"],
    "COVERAGE_TYPE": ["commercial general liability", "umbrella coverage"],
    "CLAIM_STATUS": ["pending review"],
    "PROPERTY_TYPE": ["wood-frame residential"],
    "POLICY_NUMBER": ["PLY-2024-00892"],
}


def _features(spark, summary):
    df = spark.createDataFrame([(1, summary)], "id int, m map<string,array<string>>")
    return df.select(*feature_columns("m")).first().asDict()


def test_underwriting_sample(spark):
    f = _features(spark, UNDERWRITING)
    assert f["entity_count_peril"] == 2
    assert f["entity_count_money"] == 2
    assert f["entity_count_coverage"] == 2
    assert f["has_fire_peril"] == 1.0
    assert f["has_umbrella_coverage"] == 1.0
    assert f["has_flood_peril"] == 0.0
    assert f["prior_claims_indicator"] == 1.0
    assert f["property_risk_score"] == pytest.approx(0.8)
    assert f["entity_count_total"] == 10
    assert f["max_monetary_value"] == pytest.approx(0.5)
    assert f["mean_monetary_value"] == pytest.approx(0.275)


def test_empty_summary(spark):
    f = _features(spark, {})
    assert len(f) == 28 and list(f) == vocab.FEATURE_NAMES
    assert f["entity_count_total"] == 0
    assert f["property_risk_score"] == 0.5


def test_incident_details(spark):
    f = _features(spark, {
        "INJURY": ["2 bodily injuries"], "INCIDENT_DETAIL": ["3 vehicles involved", "police contacted"],
        "VEHICLE": ["Dodge Neon", "Dodge Neon (2003)"], "PERIL": ["windstorm", "multi-vehicle"],
    })
    assert f["bodily_injury_count"] == 2
    assert f["vehicles_involved"] == 3
    assert f["witness_count"] == 0
    assert f["police_involved"] == 1.0
    assert f["vehicle_age"] == 21
    assert f["has_wind_peril"] == 1.0  # substring test: "windstorm" counts
    assert f["multi_vehicle_incident"] == 1.0


@pytest.mark.parametrize("text,expected", [
    ("$50,000", 0.05), ("$1.5 million", 1.5), ("$2 billion", 2000.0), ("not a number", None),
    ("$50k", 0.05), ("approx $50k", 0.05), ("2M", 2.0), ("$1.5M", 1.5), ("1.2.3", None), (".", None),
    ("€1,000", 0.001),
])
def test_parse_money(spark, text, expected):
    got = spark.createDataFrame([(text,)], "t string").select(parse_money("t").alias("v")).first()["v"]
    if expected is None:
        assert got is None
    else:
        assert got == pytest.approx(expected)


@pytest.mark.parametrize("p,tier", [
    (0.10, "LOW"), (0.30, "MODERATE"), (0.60, "HIGH"), (0.80, "CRITICAL"),
    (0.25, "MODERATE"), (0.50, "HIGH"), (0.75, "CRITICAL"), (0.24999, "LOW"),
])
def test_risk_tier(spark, p, tier):
    assert spark.createDataFrame([(p,)], "p double").select(risk_tier("p")).first()[0] == tier


def test_score_rounding_and_clamp(spark):
    df = spark.createDataFrame([(0.24999, -10.0), (0.9, 1234.567)], "raw_probability double, raw_amount double")
    rows = score(df).orderBy("raw_probability").collect()
    assert rows[0]["risk_tier"] == "LOW" and rows[0]["risk_probability"] == 0.25
    assert rows[0]["predicted_claim_amount"] == 0.0
    assert rows[1]["confidence_score"] == pytest.approx(0.8)
    assert rows[1]["predicted_claim_amount"] == pytest.approx(1234.57)
