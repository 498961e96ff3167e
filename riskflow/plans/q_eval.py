"""Registered queries: stratified selection and evaluation (O-W4, O-Q12..O-Q21)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import vocab
from ..operators import evaluate as oe
from ..operators import quality as oq
from ..operators.scoring import score
from ..session import checkpoint_dir, staged
from ..sources.reports import read_report, write_report
from . import sql_views as sv
from . import views
from .registry import register
from .q_quality import judge_parse

C = sv.with_ctes
_STRATA = sv.case_map({s: i for i, s in enumerate(vocab.SEVERITY_STRATA)}, "incident_severity")

SAMPLE_SQL = f"""base AS (
  SELECT case_id, incident_severity, fraud_reported, coalesce(fraud_reported = 'Y', false) AS fr,
    CAST(('0x' || substr(md5('42' || CAST(case_id AS VARCHAR)), 1, 8)) AS BIGINT) AS h,
    CAST({_STRATA} AS INTEGER) AS stratum_no
  FROM claims WHERE incident_severity IN {tuple(vocab.SEVERITY_STRATA)}),
ff AS (SELECT stratum_no, case_id AS ff_id FROM (
  SELECT *, row_number() OVER (PARTITION BY stratum_no ORDER BY h, case_id) AS rn FROM base WHERE fr) WHERE rn = 1),
sample AS (
  SELECT * FROM (
    SELECT b.case_id, b.stratum_no, b.incident_severity, b.fraud_reported,
      CAST(row_number() OVER (PARTITION BY b.stratum_no ORDER BY
        CASE WHEN b.case_id = ff.ff_id THEN 0 WHEN NOT b.fr THEN 1 ELSE 2 END, b.h, b.case_id) AS INTEGER) AS pick_no
    FROM base b LEFT JOIN ff USING (stratum_no)) WHERE pick_no <= 5)"""


@register("stratified_sample", C(sv.CLAIMS, SAMPLE_SQL) + "SELECT * FROM sample")
def stratified_sample(spark, sf_dir):
    """O-W4: five claims per severity, one fraud case first, seeded order."""
    c = views.claims(spark, sf_dir).select("case_id", "incident_severity", "fraud_reported")
    return oe.stratified_sample(c, "case_id", "incident_severity", n=5, seed=42).select(
        "case_id", "stratum_no", "incident_severity", "fraud_reported", F.col("pick_no").cast("int")
    )


def _predictions(spark, sf_dir):
    a = views.analysis(spark, sf_dir)
    return a.select(
        F.col("submission_id").alias("case_id"), "risk_tier", "risk_probability", "predicted_claim_amount",
        "key_risk_factors", "similar_cases",
        ((F.col("submission_id") % 50).cast("double") + 9.1).alias("processing_time_ms"),
    )


def _evaluate(spark, sf_dir, cases=None):
    c = views.claims(spark, sf_dir).select(
        "case_id", "incident_type", "incident_severity", "fraud_reported", "total_claim_amount"
    ) if cases is None else cases
    return oe.evaluate_cases(c, _predictions(spark, sf_dir), _second_scoring(spark, sf_dir))


def _second_scoring(spark, sf_dir):
    """The same submissions scored again; every 10th probability comes out 0.01
    higher, so the consistency check has something to find."""
    shifted = views.scored(spark, sf_dir).withColumn(
        "raw_probability", F.col("raw_probability") + F.when(F.col("submission_id") % 10 == 0, 0.01).otherwise(0.0)
    )
    return score(shifted).select(F.col("submission_id").alias("case_id"), "risk_probability", "predicted_claim_amount")


_TIER_RANK = lambda x: sv.case_map(vocab.TIER_ORDER, x, "-1")
_VALID = sv.sql_list(oq.VALID_NAMES)

EVAL_SQL = f""", nb AS (
  SELECT submission_id, CAST(count(*) AS BIGINT) AS n, arg_min(similarity_score, j) AS top_sim,
    list(lower(summary)) AS summaries FROM neighbours GROUP BY submission_id),
bad_f AS (SELECT submission_id, count(*) AS n_bad FROM an_factors
          WHERE name <> '' AND NOT list_contains({_VALID}, name) GROUP BY submission_id),
ev AS (
  SELECT c.case_id AS case_index, coalesce(c.incident_type, '') AS incident_type,
    coalesce(c.incident_severity, '') AS incident_severity, coalesce(c.fraud_reported, '') AS fraud_reported,
    coalesce(TRY_CAST(NULLIF(c.total_claim_amount, '') AS DOUBLE), 0.0) AS actual_claim_amount,
    {sv.case_map(vocab.SEVERITY_TO_TIER, "coalesce(c.incident_severity, '')", "'MODERATE'")} AS expected_tier,
    coalesce(s.risk_tier, '') AS predicted_tier,
    coalesce(s.risk_probability, 0.0) AS risk_probability,
    coalesce(s.predicted_claim_amount, 0.0) AS predicted_claim_amount,
    coalesce(nb.n, 0) AS rag_result_count,
    coalesce(nb.top_sim, 0.0) AS rag_top_similarity,
    coalesce(len(list_filter(nb.summaries, lambda x: contains(x, lower(coalesce(c.incident_type, ''))))) > 0, false) AS rag_type_match,
    (CAST(c.case_id % 50 AS DOUBLE) + 9.1) AS processing_time_ms,
    coalesce(bf.n_bad, 0) = 0 AS shap_grounded,
    coalesce(round(z.raw_probability + CASE WHEN c.case_id % 10 = 0 THEN 0.01 ELSE 0.0 END, 4), -1.0) = coalesce(s.risk_probability, 0.0)
      AND coalesce(round(greatest(z.raw_amount, 0.0), 2), -1.0) = coalesce(s.predicted_claim_amount, 0.0) AS consistency_passed
  FROM cases_in c LEFT JOIN scored z ON z.submission_id = c.case_id LEFT JOIN score_out s ON s.submission_id = c.case_id
  LEFT JOIN nb ON nb.submission_id = c.case_id LEFT JOIN bad_f bf ON bf.submission_id = c.case_id),
ev2 AS (
  SELECT *, predicted_tier = expected_tier AS tier_match,
    abs({_TIER_RANK('expected_tier')} - {_TIER_RANK('predicted_tier')}) <= 1 AS tier_adjacent,
    CASE WHEN predicted_claim_amount <= 0 THEN false WHEN actual_claim_amount <= 0 THEN predicted_claim_amount > 0
         ELSE predicted_claim_amount / actual_claim_amount >= 0.05 AND predicted_claim_amount / actual_claim_amount <= 20.0 END
      AS claim_reasonable
  FROM ev),
results AS (
  SELECT *, CASE WHEN tier_match THEN 'PASS' WHEN tier_adjacent THEN '~' ELSE 'FAIL' END AS status FROM ev2)"""

_BASE_CTES = (sv.CLAIMS, sv.CLAIM_CASES, sv.SCORED, sv.SCORE_OUT, sv.FACTORS, sv.TOP_FACTORS, sv.AN_FACTORS,
              sv.NEIGHBOURS)
ALL_CASES = "cases_in AS (SELECT * FROM claims)"
SAMPLE_CASES = "cases_in AS (SELECT c.* FROM claims c JOIN sample USING (case_id))"

METRICS_SQL = """SELECT CAST(count(*) AS BIGINT) AS total_cases,
  CAST(count(*) FILTER (WHERE tier_match) AS BIGINT) AS tier_exact_match,
  CAST(count(*) FILTER (WHERE tier_adjacent) AS BIGINT) AS tier_adjacent_match,
  CAST(count(*) FILTER (WHERE consistency_passed) AS BIGINT) AS consistency_passed,
  CAST(count(*) FILTER (WHERE shap_grounded) AS BIGINT) AS shap_grounded,
  CAST(count(*) FILTER (WHERE claim_reasonable) AS BIGINT) AS claim_reasonable,
  CAST(count(*) FILTER (WHERE rag_type_match) AS BIGINT) AS rag_type_match,
  round(coalesce(sum(rag_top_similarity) / count(*), 0.0), 4) AS mean_rag_similarity,
  round(coalesce(avg(rag_top_similarity) FILTER (WHERE rag_result_count > 0), 0.0), 4) AS mean_rag_similarity_with_results,
  round(coalesce(sum(processing_time_ms) / count(*), 0.0), 1) AS mean_processing_time_ms
FROM results"""


@register("evaluate_cases", C(*_BASE_CTES, ALL_CASES) + EVAL_SQL + "\nSELECT * FROM results")
def evaluate_cases(spark, sf_dir):
    """O-Q12..O-Q16: every claim evaluated against the stand-in predictions."""
    return _evaluate(spark, sf_dir)


@register("eval_metrics", C(*_BASE_CTES, ALL_CASES) + EVAL_SQL + "\n" + METRICS_SQL)
def eval_metrics(spark, sf_dir):
    """O-Q17 over all claims."""
    return oe.eval_metrics(_evaluate(spark, sf_dir))


@register(
    "eval_report",
    C(*_BASE_CTES, ALL_CASES) + EVAL_SQL + ", m AS (" + METRICS_SQL
    + ")\nSELECT results.*, m.total_cases, m.tier_exact_match AS n_exact, m.mean_processing_time_ms AS mean_ms FROM results, m",
)
def eval_report(spark, sf_dir):
    """O-S7: the evaluation of every claim written as a report and read back: its
    case lines beside the figures of its one document."""
    results = staged(_evaluate(spark, sf_dir), "evaluated")
    path = f"{checkpoint_dir(spark).rstrip('/')}/eval-report-{uuid.uuid4().hex[:12]}"
    write_report(oe.eval_metrics(results), results, path, timestamp="2026-01-01T00:00:00+00:00")
    metrics, cases = read_report(spark, path, results.schema)
    m = metrics.first()  # one row
    return cases.withColumns({
        "total_cases": F.lit(m["total_cases"]).cast("bigint"),
        "n_exact": F.lit(m["tier_exact_match"]).cast("bigint"), "mean_ms": F.lit(m["mean_processing_time_ms"]).cast("double"),
    })


@register("eval_sample_metrics", C(*_BASE_CTES, SAMPLE_SQL, SAMPLE_CASES) + EVAL_SQL + "\n" + METRICS_SQL)
def eval_sample_metrics(spark, sf_dir):
    """O-W4 -> O-Q16 -> O-Q17: the evaluation job (20 stratified cases)."""
    c = views.claims(spark, sf_dir).select(
        "case_id", "incident_type", "incident_severity", "fraud_reported", "total_claim_amount"
    )
    sample = oe.stratified_sample(c, "case_id", "incident_severity", n=5, seed=42).select(
        "case_id", "incident_type", "incident_severity", "fraud_reported", "total_claim_amount"
    )
    return oe.eval_metrics(_evaluate(spark, sf_dir, sample))


@register(
    "confusion",
    C(*_BASE_CTES, ALL_CASES) + EVAL_SQL
    + "\nSELECT expected_tier, predicted_tier, CAST(count(*) AS BIGINT) AS n FROM results GROUP BY ALL",
)
def confusion(spark, sf_dir):
    """O-Q18: expected x predicted tier counts."""
    return oe.confusion(_evaluate(spark, sf_dir))


@register(
    "eval_display",
    C(*_BASE_CTES, ALL_CASES) + EVAL_SQL + ", m AS (" + METRICS_SQL + """)
SELECT metric, CAST(value AS BIGINT) AS value, CAST(pct AS BIGINT) AS percent,
  CASE WHEN pct >= 100 THEN 'good' WHEN pct >= 50 THEN 'fair' ELSE 'poor' END AS band
FROM (SELECT metric, value, CASE WHEN total_cases > 0 THEN floor(value / total_cases * 100 + 0.5) ELSE 0 END AS pct
      FROM (UNPIVOT (SELECT total_cases, CAST(tier_exact_match AS DOUBLE) AS tier_exact_match,
                       CAST(tier_adjacent_match AS DOUBLE) AS tier_adjacent_match,
                       CAST(consistency_passed AS DOUBLE) AS consistency_passed,
                       CAST(shap_grounded AS DOUBLE) AS shap_grounded FROM m)
            ON tier_exact_match, tier_adjacent_match, consistency_passed, shap_grounded
            INTO NAME metric VALUE value))""",
)
def eval_display(spark, sf_dir):
    """O-Q21: metric percents and bands."""
    return oe.eval_display(oe.eval_metrics(_evaluate(spark, sf_dir)))


@register(
    "narrative_eval",
    C(*_BASE_CTES, ALL_CASES, sv.NARRATIVES) + EVAL_SQL + """,
firsts AS (
  SELECT bucket, min(case_index) AS case_index, arg_min(predicted_tier, case_index) AS predicted_tier FROM (
    SELECT case_index, predicted_tier, CASE WHEN predicted_tier IN ('HIGH', 'CRITICAL') THEN 'high'
      WHEN predicted_tier = 'MODERATE' THEN 'moderate' WHEN predicted_tier = 'LOW' THEN 'low' END AS bucket
    FROM results) WHERE bucket IS NOT NULL GROUP BY bucket)
SELECT f.bucket, f.case_index, CAST(length(coalesce(n.narrative, '')) AS BIGINT) AS narrative_length,
  coalesce(regexp_extract(n.narrative, 'assessed as ([A-Z]+) risk', 1), '') = f.predicted_tier AS tier_matches_prediction,
  coalesce((SELECT bool_or(a.name <> '' AND contains(lower(coalesce(n.narrative, '')), lower(a.name)))
            FROM an_factors a WHERE a.submission_id = f.case_index), false) AS references_shap_factor
FROM firsts f LEFT JOIN narratives n ON n.submission_id = f.case_index""",
)
def narrative_eval(spark, sf_dir):
    """O-Q19: narrative checks on the first case of each predicted tier bucket."""
    cases = views.claims(spark, sf_dir).select("case_id")
    tiers = score(views.scored(spark, sf_dir)).select(F.col("submission_id").alias("case_id"), F.col("risk_tier").alias("predicted_tier"))
    res = cases.join(tiers, "case_id").select(F.col("case_id").alias("case_index"), F.col("case_id").alias("case_order"), "predicted_tier")
    # at most three ids: the scans below read only their records
    ids = [r["case_index"] for r in oe.first_of_each_tier(res).collect()]
    res = res.where(F.col("case_index").isin(ids))
    p = _predictions(spark, sf_dir).where(F.col("case_id").isin(ids)).select(
        F.col("case_id").alias("case_index"), "key_risk_factors")
    nar = views.narratives(spark, sf_dir).where(F.col("submission_id").isin(ids)).select(
        F.col("submission_id").alias("case_index"), F.col("narrative").alias("underwriter_narrative")
    )
    tier = F.regexp_extract("underwriter_narrative", r"assessed as ([A-Z]+) risk", 1)  # the tier that the text names
    res = res.join(p, "case_index", "left").join(nar.select("case_index", tier.alias("narrative_tier")), "case_index", "left")
    return oe.narrative_eval(res, nar, "case_index")


@register(
    "hallucination_rate",
    """WITH j AS (SELECT event_id,
  CASE WHEN json_valid(reply) AND coalesce(TRY_CAST(TRY_CAST(reply AS JSON)->>'$.confidence' AS DOUBLE), 0.0) BETWEEN 0 AND 1
       THEN coalesce(TRY_CAST(TRY_CAST(reply AS JSON)->>'$.hallucination_detected' AS BOOLEAN), false) ELSE false END AS detected
  FROM (SELECT event_id, CASE WHEN event_id % 7 = 0 THEN 'not valid json'
          ELSE '{"hallucination_detected": ' || CASE WHEN value > 50 THEN 'true' ELSE 'false' END
               || ', "hallucination_count": ' || CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR)
               || ', "details": [], "confidence": ' || CAST(CAST(floor(value) AS BIGINT) // 60 AS VARCHAR) || '.'
               || lpad(CAST(CAST(floor(value) AS BIGINT) % 100 AS VARCHAR), 2, '0') || '}' END AS reply FROM events))
SELECT CAST(count(*) FILTER (WHERE detected) AS BIGINT) AS flagged, CAST(count(*) AS BIGINT) AS total,
  round(coalesce(avg(CAST(detected AS DOUBLE)) * 100, 0.0), 6) AS rate_pct FROM j""",
)
def hallucination_rate(spark, sf_dir):
    """O-Q20 / O-A5: share of judged narratives flagged."""
    return oe.hallucination_rate(judge_parse(spark, sf_dir), "detected")
