"""Registered queries: assembly, audit and the end-to-end assessment (O-J*, O-S6, O-A10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import assemble as oa
from ..operators import claims as oc
from ..operators import entities as oent
from ..operators import evaluate as oe
from ..operators import explain as ox
from ..operators import monitor as om
from ..operators import scoring as om_score
from ..operators import vectors as ov
from ..operators.case_index import CaseIndex, build_case_index, open_case_index
from ..operators.vectors import SAMPLE_QUERIES
from ..functions.text import entities_to_text
from . import sql_views as sv
from . import views
from .. import vocab
from ..session import checkpoint_dir
from .q_entities import _SUB_LABELS as SUB_LABELS
from .q_entities import DEDUP_CTE, ENTITIES_CTE, LISTS_CTE, SUMMARY_LONG_CTE
from .q_quality import LINEAR_BETA, LINEAR_MEANS, LINEAR_MODEL, SEVERITY_MODEL
from .registry import register

C = sv.with_ctes


def _analysis_parts(spark, sf_dir):
    k = F.col("submission_id")
    subs = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("submission_id"))
    pred = om_score.score(views.scored(spark, sf_dir)).where(k % 13 != 0).select(
        "submission_id", "risk_tier", "risk_probability", "predicted_claim_amount", "confidence_score"
    )
    fac = views.factors(spark, sf_dir).select(
        "submission_id", ox.factor_list(ox.ranked_factors(F.col("shap_values"))).alias("key_risk_factors")
    )
    nb = views.neighbour_rows(spark, sf_dir).groupBy("submission_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("j", "policy_id", "similarity_score", "summary", "outcome"))),
            lambda c: F.struct(c["policy_id"].alias("policy_id"), c["similarity_score"].alias("similarity_score"),
                               c["summary"].alias("summary"), c["outcome"].alias("outcome")),
        ).alias("similar_cases")
    )
    nar = views.narratives(spark, sf_dir).withColumnRenamed("narrative", "underwriter_narrative")
    return subs, pred, fac, nb, nar


def _assembled(spark, sf_dir):
    return oa.assemble_analysis(*_analysis_parts(spark, sf_dir), None, "submission_id")


ASSEMBLE_SQL = C(sv.CLAIMS, sv.CLAIM_CASES, sv.SCORED, sv.SCORE_OUT, sv.FACTORS, sv.TOP_FACTORS, sv.NEIGHBOURS,
                 sv.NARRATIVES) + """, assembled AS (
  SELECT o.o_orderkey AS submission_id,
    coalesce(p.risk_tier, 'MODERATE') AS risk_tier, coalesce(p.risk_probability, 0.5) AS risk_probability,
    coalesce(p.predicted_claim_amount, 0.0) AS predicted_claim_amount, coalesce(p.confidence_score, 0.5) AS confidence_score,
    CASE WHEN p.submission_id IS NULL THEN 0 ELSE coalesce(f.n, 0) END AS n_factors,
    coalesce(nb.n, 0) AS n_similar,
    CAST(length(coalesce(n.narrative, '')) AS BIGINT) AS narrative_chars,
    p.submission_id IS NULL AS is_fallback
  FROM orders o
  LEFT JOIN (SELECT * FROM score_out WHERE submission_id % 13 <> 0) p ON p.submission_id = o.o_orderkey
  LEFT JOIN (SELECT submission_id, CAST(count(*) AS BIGINT) AS n FROM top_factors GROUP BY 1) f ON f.submission_id = o.o_orderkey
  LEFT JOIN (SELECT submission_id, CAST(count(*) AS BIGINT) AS n FROM neighbours GROUP BY 1) nb ON nb.submission_id = o.o_orderkey
  LEFT JOIN narratives n ON n.submission_id = o.o_orderkey)"""


@register("assemble_analysis", ASSEMBLE_SQL + "SELECT * FROM assembled")
def assemble_analysis(spark, sf_dir):
    """O-J1/O-J2: per-submission assessment; every 13th prediction missing
    -> fallback values (MODERATE, 0.5, 0.0, no factors, confidence 0.5)."""
    a = _assembled(spark, sf_dir)
    return a.select(
        "submission_id", "risk_tier", "risk_probability", "predicted_claim_amount", "confidence_score",
        F.size("key_risk_factors").cast("bigint").alias("n_factors"),
        F.size("similar_cases").cast("bigint").alias("n_similar"),
        F.length("underwriter_narrative").cast("bigint").alias("narrative_chars"),
        "is_fallback",
    )


_STAGE_MAP = {"view": "ingestion", "click": "prediction", "purchase": "rag", "signup": "llm"}


@register(
    "stage_trace",
    f"""SELECT user_id AS submission_id, round(ingestion_ms, 6) AS ingestion_ms, round(prediction_ms, 6) AS prediction_ms,
  round(rag_ms, 6) AS rag_ms, round(llm_ms, 6) AS llm_ms,
  round(coalesce(ingestion_ms, 0.0) + coalesce(prediction_ms, 0.0) + coalesce(rag_ms, 0.0) + coalesce(llm_ms, 0.0), 6) AS total_ms,
  ingestion_ms IS NULL OR prediction_ms IS NULL OR rag_ms IS NULL OR llm_ms IS NULL AS has_missing_stage
FROM (SELECT user_id,
    sum(value) FILTER (WHERE event_type = 'view') AS ingestion_ms,
    sum(value) FILTER (WHERE event_type = 'click') AS prediction_ms,
    sum(value) FILTER (WHERE event_type = 'purchase') AS rag_ms,
    sum(value) FILTER (WHERE event_type = 'signup') AS llm_ms
  FROM events WHERE event_type IN ('view', 'click', 'purchase', 'signup') GROUP BY user_id)""",
)
def stage_trace(spark, sf_dir):
    """O-J3: stage times per submission from the event stream."""
    e = views.table(spark, sf_dir, "events")
    stages = e.where(F.col("event_type").isin(*_STAGE_MAP)).select(
        F.col("user_id").alias("submission_id"),
        F.try_element_at(F.create_map(*[F.lit(x) for kv in _STAGE_MAP.items() for x in kv]), F.col("event_type"))
        .alias("stage"),
        F.col("value").alias("ms"),
    )
    out = oa.stage_trace(stages, "submission_id", "stage", "ms")
    # sums of doubles: compare at 6 places (summation order differs between engines)
    return out.select("submission_id", *[F.round(f"{n}_ms", 6).alias(f"{n}_ms") for n in
                                         ["ingestion", "prediction", "rag", "llm", "total"]], "has_missing_stage")


def _audit(spark, sf_dir):
    k = F.col("submission_id")
    found = F.struct((k % 4 == 0).alias("detected"), F.lit(1).alias("count"), F.array(F.lit("flag")).alias("flags"),
                     ((k % 10).cast("double") / 10.0).alias("confidence"))
    subs, pred, fac, nb, nar = _analysis_parts(spark, sf_dir)
    checks = subs.where(k % 3 != 0).select("submission_id", found.alias("hallucination_check"))  # the rest unjudged
    a = oa.assemble_analysis(subs, pred, fac, nb, nar, checks, "submission_id").withColumn(
        "processing_time_ms", (k % 50).cast("double") + 9.1)
    return oa.audit_events(
        a,
        F.when(k % 2 == 0, F.lit("hosted")).otherwise(F.lit("local")),
        request_id=F.concat(F.lit("req-"), k.cast("string")),
        timestamp=F.lit("2024-01-01T00:00:00+00:00"),
    )


AUDIT_SQL = ASSEMBLE_SQL + """, audit AS (
  SELECT '2024-01-01T00:00:00+00:00' AS timestamp, 'req-' || CAST(a.submission_id AS VARCHAR) AS request_id,
    CAST(a.submission_id AS VARCHAR) AS submission_id, a.risk_tier, a.risk_probability, a.predicted_claim_amount,
    a.confidence_score, CAST(a.submission_id % 50 AS DOUBLE) + 9.1 AS processing_time_ms,
    CAST(a.n_similar AS INTEGER) AS similar_cases_count, CASE WHEN a.submission_id % 3 <> 0 THEN a.submission_id % 4 = 0 END AS hallucination_detected,
    CASE WHEN a.submission_id % 3 <> 0 THEN CAST(a.submission_id % 10 AS DOUBLE) / 10.0 END AS hallucination_confidence,
    CASE WHEN a.submission_id % 2 = 0 THEN 'hosted' ELSE 'local' END AS provider
  FROM assembled a)"""


@register("audit_events", AUDIT_SQL + "SELECT * FROM audit")
def audit_events(spark, sf_dir):
    """O-S6: the flat audit record of every assessment."""
    return _audit(spark, sf_dir)


@register(
    "audit_rollup",
    AUDIT_SQL + """SELECT risk_tier, provider, CAST(count(*) AS BIGINT) AS n,
  round(avg(risk_probability), 6) AS mean_probability, round(avg(processing_time_ms), 6) AS mean_processing_ms,
  round(coalesce(avg(CAST(hallucination_detected AS DOUBLE)), 0.0), 6) AS detection_share
FROM audit GROUP BY ALL""",
)
def audit_rollup(spark, sf_dir):
    """O-A10: audit records by tier and provider."""
    return om.audit_summary(_audit(spark, sf_dir))


PICK_IDS = [1, 2, 3, 5, 7, 10_000_000_000]


@register("pick_cases", C(sv.CLAIMS) + f"SELECT case_id, incident_severity FROM claims WHERE case_id IN {tuple(PICK_IDS)}")
def pick_cases(spark, sf_dir):
    """O-J4: explicit case ids override the selection; unknown ids are ignored."""
    c = views.claims(spark, sf_dir).select("case_id", "incident_severity")
    return oe.pick_cases(c, PICK_IDS, "case_id")


@register("narrative_context")
def narrative_context(spark, sf_dir):
    """O-T13: generator input per submission (JSON text; no SQL oracle since
    JSON number formatting differs between engines)."""
    a = views.analysis(spark, sf_dir)
    pages = views.submission_pages(spark, sf_dir)
    from ..operators.text import full_text

    ft = full_text(pages, "doc_id").withColumnRenamed("doc_id", "submission_id")
    return oa.narrative_context(a.join(ft, "submission_id", "left"), "submission_id")


_PARTS_SQL = """, facts AS (
  SELECT s.submission_id, s.risk_tier, s.risk_probability, coalesce(f.n, 0) AS n_factors, coalesce(nb.n, 0) AS n_similar
  FROM score_out s
  LEFT JOIN (SELECT submission_id, CAST(count(*) AS BIGINT) AS n FROM top_factors GROUP BY 1) f USING (submission_id)
  LEFT JOIN (SELECT submission_id, CAST(count(*) AS BIGINT) AS n FROM neighbours GROUP BY 1) nb USING (submission_id))"""
_ANALYSIS_CTES = (sv.CLAIMS, sv.CLAIM_CASES, sv.SCORED, sv.SCORE_OUT, sv.FACTORS, sv.TOP_FACTORS, sv.NEIGHBOURS)


def _json_facts(j, factors, cases):
    """The fields of a context's JSON that SQL can derive."""
    return [
        F.get_json_object(j, "$.risk_tier").alias("risk_tier"),
        F.get_json_object(j, "$.risk_probability").cast("double").alias("risk_probability"),
        F.coalesce(F.json_array_length(F.get_json_object(j, f"$.{factors}")), F.lit(0)).cast("bigint").alias("n_factors"),
        F.coalesce(F.json_array_length(cases), F.lit(0)).cast("bigint").alias("n_similar"),
    ]


@register(
    "narrative_context_check",
    C(*_ANALYSIS_CTES, sv.SUBMISSION_PAGES) + _PARTS_SQL + """, ft AS (SELECT doc_id,
    string_agg(text, chr(10) || chr(10) ORDER BY page_number) AS t FROM submission_pages GROUP BY doc_id)
SELECT facts.*, coalesce(substring(t, 1, 2000), '') AS excerpt FROM facts LEFT JOIN ft ON doc_id = submission_id""",
)
def narrative_context_check(spark, sf_dir):
    """O-T13, read back from the context text: the excerpt and the JSON fields."""
    c = F.col("context")
    pred = F.regexp_extract(c, r"(?s)\n\nPrediction: (\{.*\})\n\nSimilar cases: ", 1)
    cases = F.regexp_extract(c, r"(?s)\n\nSimilar cases: (\[.*\])$", 1)
    excerpt = F.regexp_extract(c, r"(?s)^Entities: \{.*?\}\n\nDocument excerpt:\n(.*)\n\nPrediction: ", 1)
    return narrative_context(spark, sf_dir).select(
        "submission_id", *_json_facts(pred, "key_risk_factors", cases), excerpt.alias("excerpt")
    )


@register(
    "judge_context_check",
    C(*_ANALYSIS_CTES, sv.NARRATIVES) + _PARTS_SQL
    + "SELECT facts.*, coalesce(narrative, '') AS narrative FROM facts LEFT JOIN narratives USING (submission_id)",
)
def judge_context_check(spark, sf_dir):
    """O-T14, read back from the context text: the narrative and the JSON fields."""
    c = F.col("judge_context")
    facts = F.regexp_extract(c, r"(?s)^Source data: (\{.*?\})\n\nNarrative:\n", 1)
    return judge_context(spark, sf_dir).select(
        "submission_id", *_json_facts(facts, "risk_factors", F.get_json_object(facts, "$.similar_cases")),
        F.regexp_extract(c, r"(?s)\n\nNarrative:\n(.*)$", 1).alias("narrative"),
    )


@register("judge_context")
def judge_context(spark, sf_dir):
    """O-T14: auditor input per assessment (JSON text)."""
    return oa.judge_context(views.analysis(spark, sf_dir), "submission_id")


def case_index(spark, sf_dir, dim: int = 384):
    """The claim case index: O-C2 summaries -> O-T9 text -> O-V1 vectors, with O-C3 records."""
    c = views.claims(spark, sf_dir)
    ents = oc.claim_entities(c, "index").select("case_id", entities_to_text("entity_summary").alias("t"))
    vecs = ov.hash_embed(ents, "case_id", "t", dim)
    return oc.claim_cases(c).join(vecs, "case_id")


_LINEAR_ROWS = ", ".join(
    f"('{n}', {i}, {LINEAR_BETA[n]}, {LINEAR_MEANS[n]}, {SEVERITY_MODEL.coefficients[n]})" for i, n in enumerate(vocab.FEATURE_NAMES)
)
END_TO_END_SQL = C(sv.SUBMISSION_PAGES, ENTITIES_CTE, DEDUP_CTE, SUMMARY_LONG_CTE, LISTS_CTE, sv.NARRATIVES) + f""",
feats AS (SELECT doc_id, {sv.features({lab: f"l_{lab.lower()}" for lab in SUB_LABELS}, "total")} FROM doc_lists),
terms(feature, i, beta, mean, amount) AS (VALUES {_LINEAR_ROWS}),
phi AS (SELECT doc_id, feature, i, beta * (value - mean) AS v, amount * (value - mean) AS a
  FROM (UNPIVOT feats ON {", ".join(vocab.FEATURE_NAMES)} INTO NAME feature VALUE value) JOIN terms USING (feature)),
sums AS (SELECT doc_id, 1 / (1 + exp(-({LINEAR_MODEL.intercept} + sum(v ORDER BY i)))) AS p,
    {SEVERITY_MODEL.intercept} + sum(a ORDER BY i) AS amount, count(*) FILTER (WHERE abs(v) >= 1e-6) AS n FROM phi GROUP BY doc_id),
top AS (SELECT doc_id, feature FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY abs(v) DESC, i) AS r FROM phi) WHERE r = 1)
SELECT doc_id, CASE WHEN p < 0.25 THEN 'LOW' WHEN p < 0.5 THEN 'MODERATE' WHEN p < 0.75 THEN 'HIGH' ELSE 'CRITICAL' END AS risk_tier,
  round(p, 4) AS risk_probability, round(greatest(amount, 0.0), 2) AS predicted_claim_amount, round(abs(p - 0.5) * 2.0, 4) AS confidence_score,
  CAST(least(n, 5) AS BIGINT) AS n_factors, {sv.case_map(vocab.FEATURE_DISPLAY_NAMES, "feature", "feature")} AS top_factor,
  true AS shap_grounded, CAST(length(coalesce(narrative, '')) AS BIGINT) AS narrative_chars
FROM sums JOIN top USING (doc_id) LEFT JOIN narratives ON submission_id = doc_id"""


def submission_vectors(spark, sf_dir, ids, dim: int = 384):
    """Search vectors of the submissions named in ``ids`` (doc_id)."""
    pages = views.submission_pages(spark, sf_dir).join(F.broadcast(ids), "doc_id", "left_semi")
    found = oent.summarize_entities(oent.dedup_entities(oent.extract_entities(pages, "doc_id", clean=True, offsets=False, nested=True)), "doc_id")
    return ov.hash_embed(found.select("doc_id", entities_to_text("entity_summary").alias("t")), "doc_id", "t", dim)


def stored_index(spark, sf_dir) -> CaseIndex:
    """The claim case index, built once under the shared folder and opened by
    every query after.  Its name is a digest of the claim tables' files (path,
    size, time), so changed tables get an index of their own."""
    files = [views.table(spark, sf_dir, t).select("_metadata.file_path", "_metadata.file_size", "_metadata.file_modification_time")
             for t in ("orders", "customer", "nation")]
    seen = files[0].unionByName(files[1]).unionByName(files[2]).distinct()
    name = seen.agg(F.md5(F.to_json(F.array_sort(F.collect_list(F.struct("*")))))).first()[0]  # one row a file
    path = f"{checkpoint_dir(spark).rstrip('/')}/claim-index-{name}"
    try:
        return open_case_index(spark, path)
    except FileNotFoundError:
        ids = views.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"))
        ids = ids.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_QUERIES)
        like = submission_vectors(spark, sf_dir, ids).select("vector")
        return build_case_index(case_index(spark, sf_dir), path, like=like)


def _assess(spark, sf_dir):
    cases = stored_index(spark, sf_dir)
    nar = views.narratives(spark, sf_dir).select(F.col("submission_id").alias("doc_id"), F.col("narrative").alias("underwriter_narrative"))
    return oa.assess(views.submission_pages(spark, sf_dir), cases, oa.linear_scorer(LINEAR_MODEL, SEVERITY_MODEL),
                     key="doc_id", narratives=nar)


@register("end_to_end", END_TO_END_SQL)
def end_to_end(spark, sf_dir):
    """O-J5: submission pages -> entities -> features -> fitted score, amount and
    factors -> neighbours from the claim case index -> assessment and quality
    checks; the columns that SQL can derive from the pages."""
    return _assess(spark, sf_dir).select(
        "doc_id", "risk_tier", "risk_probability", "predicted_claim_amount", "confidence_score",
        F.size("key_risk_factors").cast("bigint").alias("n_factors"),
        F.get("key_risk_factors", F.lit(0))["name"].alias("top_factor"), "shap_grounded",
        F.length("underwriter_narrative").cast("bigint").alias("narrative_chars"),
    )


@register("end_to_end_search")
def end_to_end_search(spark, sf_dir):
    """O-J5, the retrieval side of the same assessments: cases found for every
    document and the checks that need them (approximate search: rows only)."""
    return _assess(spark, sf_dir).select(
        "doc_id", F.size("similar_cases").cast("bigint").alias("n_similar"),
        F.get("similar_cases", F.lit(0))["similarity_score"].alias("top_similarity"), "rag_retrieved", "quality_score",
    )
