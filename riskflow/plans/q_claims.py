"""Registered queries: claims -> entity summaries -> features -> scores."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import vocab
from ..operators import claims as oc
from ..operators import features as of
from ..operators import scoring as om
from . import sql_views as sv
from . import views
from .registry import register

C = sv.with_ctes


@register(
    "claim_entities_train",
    C(sv.CLAIMS, sv.CLAIM_LISTS_TRAIN) + sv.long_from_lists("claim_lists", sv.CLAIM_LISTS_TRAIN_LABELS),
)
def claim_entities_train(spark, sf_dir):
    """O-C1: entity summary of each claim (training flavour), long form."""
    return oc.summary_long(oc.claim_entities(views.claims(spark, sf_dir), "train"), "case_id")


@register(
    "claim_entities_index",
    C(sv.CLAIMS, sv.CLAIM_LISTS_INDEX)
    + sv.long_from_lists("claim_lists_index", sv.CLAIM_LISTS_INDEX_LABELS),
)
def claim_entities_index(spark, sf_dir):
    """O-C2: entity summary of each claim (case-index flavour), long form."""
    return oc.summary_long(oc.claim_entities(views.claims(spark, sf_dir), "index"), "case_id")


_TIER_SQL = sv.case_map(vocab.SEVERITY_TO_TIER, "coalesce(incident_severity, '')", "'MODERATE'")


@register(
    "claim_cases",
    C(sv.CLAIMS)
    + f"""SELECT case_id, coalesce(policy_number, CAST(case_id AS VARCHAR)) AS policy_id,
  concat_ws(', ',
    CASE WHEN coalesce(incident_type, '') <> '' THEN lower(incident_type) END,
    CASE WHEN coalesce(auto_make, '') <> '' THEN auto_make || ' ' || coalesce(auto_model, '') END,
    'in ' || coalesce(incident_state, '?'),
    'severity: ' || lower(coalesce(incident_severity, ''))) AS summary,
  'claim $' || format('{{:,.0f}}', coalesce(TRY_CAST(NULLIF(total_claim_amount, '') AS DOUBLE), 0.0))
    || CASE WHEN fraud_reported = 'Y' THEN ' (fraud reported)' ELSE ' (no fraud)' END AS outcome,
  {_TIER_SQL} AS risk_tier,
  coalesce(TRY_CAST(NULLIF(total_claim_amount, '') AS DOUBLE), 0.0) AS claim_amount
FROM claims""",
)
def claim_cases(spark, sf_dir):
    """O-C3: case record per claim."""
    return oc.claim_cases(views.claims(spark, sf_dir))


_TARGET_SQL = sv.case_map(vocab.SEVERITY_TO_TARGET, "incident_severity", "0.0")


@register(
    "claim_targets",
    C(sv.CLAIMS)
    + f"""SELECT case_id, CAST({_TARGET_SQL} AS DOUBLE) AS severe,
  coalesce(TRY_CAST(NULLIF(total_claim_amount, '') AS DOUBLE), 0.0) AS claim_amount FROM claims""",
)
def claim_targets(spark, sf_dir):
    """O-C4: severe flag and amount target."""
    return oc.claim_targets(views.claims(spark, sf_dir))


@register(
    "label_balance",
    C(sv.CLAIMS)
    + f"""SELECT CAST(count(*) AS BIGINT) AS n, CAST(sum(s) AS BIGINT) AS n_severe,
  CAST(count(*) - sum(s) AS BIGINT) AS n_not_severe, round(avg(s), 6) AS share_severe
FROM (SELECT CAST({_TARGET_SQL} AS DOUBLE) AS s FROM claims)""",
)
def label_balance(spark, sf_dir):
    """O-C5: class balance of the severity target."""
    return oc.label_balance(oc.claim_targets(views.claims(spark, sf_dir)))


_TRAIN_TOTAL = " + ".join(f"len({c})" for _, c in sv.CLAIM_LISTS_TRAIN_LABELS)


@register(
    "features_claims",
    C(sv.CLAIMS, sv.CLAIM_LISTS_TRAIN)
    + "SELECT case_id,\n  "
    + sv.features({lab: c for lab, c in sv.CLAIM_LISTS_TRAIN_LABELS}, _TRAIN_TOTAL)
    + "\nFROM claim_lists",
)
def features_claims(spark, sf_dir):
    """O-F0..O-F9: the 28 features of every claim's entity summary."""
    ent = oc.claim_entities(views.claims(spark, sf_dir).select(
        "case_id", "incident_type", "property_damage", "policy_csl", "policy_deductable",
        "umbrella_limit", "policy_annual_premium", "capital_gains", "auto_make", "auto_model",
        "auto_year", "bodily_injuries", "number_of_vehicles_involved", "witnesses",
        "authorities_contacted"), "train")
    return of.features(ent, keep=["case_id"])


_INDEX_TOTAL = " + ".join(f"len({c})" for _, c in sv.CLAIM_LISTS_INDEX_LABELS)


@register(
    "features_claims_index",
    C(sv.CLAIMS, sv.CLAIM_LISTS_INDEX)
    + "SELECT case_id,\n  "
    + sv.features({lab: c for lab, c in sv.CLAIM_LISTS_INDEX_LABELS}, _INDEX_TOTAL)
    + "\nFROM claim_lists_index",
)
def features_claims_index(spark, sf_dir):
    """O-F0 over the case-index flavour (claim statuses, vehicles without year)."""
    return of.features(oc.claim_entities(views.claims(spark, sf_dir), "index"), keep=["case_id"])


_SCORE_SQL = """SELECT submission_id,
  CASE WHEN raw_probability < 0.25 THEN 'LOW' WHEN raw_probability < 0.5 THEN 'MODERATE'
       WHEN raw_probability < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_tier,
  round(raw_probability, 4) AS risk_probability,
  round(greatest(raw_amount, 0.0), 2) AS predicted_claim_amount,
  round(abs(raw_probability - 0.5) * 2.0, 4) AS confidence_score
FROM scored"""


@register("score", C(sv.SCORED) + _SCORE_SQL)
def score(spark, sf_dir):
    """O-M6/O-M7: tier, rounded probability, clamped amount, confidence."""
    return om.score(views.scored(spark, sf_dir)).select(
        "submission_id", "risk_tier", "risk_probability", "predicted_claim_amount", "confidence_score"
    )


@register(
    "tier_distribution",
    C(sv.SCORED)
    + """SELECT risk_tier, CAST(count(*) AS BIGINT) AS n,
  round(avg(predicted_claim_amount), 6) AS mean_amount,
  round(avg(risk_probability), 6) AS mean_probability
FROM (""" + _SCORE_SQL + ") GROUP BY risk_tier",
)
def tier_distribution(spark, sf_dir):
    """O-A4 (flagship): count per tier with mean amount and probability."""
    s = om.score(views.scored(spark, sf_dir))
    return s.groupBy("risk_tier").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("predicted_claim_amount"), 6).alias("mean_amount"),
        F.round(F.avg("risk_probability"), 6).alias("mean_probability"),
    )


@register(
    "train_test_split",
    C(sv.CLAIMS)
    + """SELECT case_id, rn <= floor(0.8 * n) AS is_train FROM (
  SELECT case_id, row_number() OVER (ORDER BY h, case_id) AS rn, count(*) OVER () AS n FROM (
    SELECT case_id, CAST(('0x' || substr(md5('42' || CAST(case_id AS VARCHAR)), 1, 8)) AS BIGINT) AS h
    FROM claims))""",
)
def train_test_split(spark, sf_dir):
    """O-M1: exact seeded 80/20 split of the claims."""
    return om.train_test_split(views.claims(spark, sf_dir).select("case_id"), "case_id", 0.8, 42)


@register(
    "roc_auc",
    C(sv.SCORED)
    + """SELECT round((sum(CASE WHEN y = 1 THEN r END) - n_pos * (n_pos + 1) / 2.0) / (n_pos * (n - n_pos)), 6) AS auc,
  CAST(n_pos AS BIGINT) AS n_pos, CAST(n - n_pos AS BIGINT) AS n_neg
FROM (SELECT y, rank() OVER (ORDER BY s) + (count(*) OVER (PARTITION BY s) - 1) / 2.0 AS r,
        sum(y) OVER () AS n_pos, count(*) OVER () AS n
      FROM (SELECT raw_probability AS s,
              CASE WHEN incident_severity IN ('Major Damage', 'Total Loss') THEN 1 ELSE 0 END AS y FROM scored))
GROUP BY n_pos, n""",
)
def roc_auc(spark, sf_dir):
    """O-M4: exact ROC AUC of the fixed score against the severity target."""
    s = views.scored(spark, sf_dir).select(
        F.col("raw_probability").alias("score"),
        F.col("incident_severity").isin("Major Damage", "Total Loss").cast("int").alias("label"),
    )
    return om.roc_auc(s)


@register(
    "regression_metrics",
    C(sv.SCORED)
    + """SELECT round(sqrt(avg((p - y) * (p - y))), 6) AS rmse, round(avg(abs(p - y)), 6) AS mae,
  CAST(count(*) AS BIGINT) AS n
FROM (SELECT greatest(raw_amount, 0.0) AS p, raw_amount AS y FROM scored)""",
)
def regression_metrics(spark, sf_dir):
    """O-M5: RMSE and MAE of the clamped amount against the raw amount."""
    s = views.scored(spark, sf_dir).select(
        F.greatest(F.col("raw_amount"), F.lit(0.0)).alias("prediction"), F.col("raw_amount").alias("label")
    )
    return om.regression_metrics(s)
