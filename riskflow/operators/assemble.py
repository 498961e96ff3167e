"""O-J1..O-J5, O-S6, O-T13/T14: assembling per-submission assessments.

Every stage output is keyed by the submission id; assembly is a chain of
left equi-joins on that one key, so each input is shuffled once (or not at
all when it is already partitioned by the key) and the joins pipeline.
Neighbour and factor lists are aggregated to arrays *before* the join, so
the join never multiplies rows.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..session import staged
from .explain import LinearModel

FACTOR_TYPE = "array<struct<name:string,shap_value:double,direction:string>>"
CASE_TYPE = "array<struct<policy_id:string,similarity_score:double,summary:string,outcome:string>>"
CHECK_TYPE = "struct<detected:boolean,count:int,flags:array<string>,confidence:double>"

# FIXED VALUES: what an assessment shows when the prediction stage failed.
FALLBACK = {"risk_tier": "MODERATE", "risk_probability": 0.5, "predicted_claim_amount": 0.0,
            "confidence_score": 0.5}


def assemble_analysis(submissions: DataFrame, predictions: DataFrame | None = None,
                      factors: DataFrame | None = None, neighbours: DataFrame | None = None,
                      narratives: DataFrame | None = None, checks: DataFrame | None = None,
                      key: str = "submission_id") -> DataFrame:
    """O-J1/O-J2: one assessment row per submission.

    ``predictions``: key, risk_tier, risk_probability, predicted_claim_amount,
    confidence_score.  ``factors``: key, key_risk_factors.  ``neighbours``:
    key, similar_cases.  ``narratives``: key, underwriter_narrative.
    ``checks``: key, hallucination_check.  A missing prediction gives the
    fallback values and ``is_fallback``; a missing retrieval gives no cases.
    """
    out = submissions.select(key, *[c for c in submissions.columns if c != key])
    if predictions is not None:
        out = out.join(predictions.withColumn("_has_pred", F.lit(True)), key, "left")
    else:
        out = out.withColumn("_has_pred", F.lit(None).cast("boolean"))
    for name, default in FALLBACK.items():
        current = F.col(name) if predictions is not None else F.lit(None)
        out = out.withColumn(name, F.coalesce(current, F.lit(default)))
    out = out.withColumn("is_fallback", F.col("_has_pred").isNull()).drop("_has_pred")
    if factors is not None:
        out = out.join(factors, key, "left")
    else:
        out = out.withColumn("key_risk_factors", F.lit(None).cast(FACTOR_TYPE))
    # the fallback carries no factors
    out = out.withColumn("key_risk_factors", F.when(F.col("is_fallback"), F.array().cast(FACTOR_TYPE)).otherwise(
        F.coalesce(F.col("key_risk_factors"), F.array().cast(FACTOR_TYPE))))
    if neighbours is not None:
        out = out.join(neighbours, key, "left")
    else:
        out = out.withColumn("similar_cases", F.lit(None).cast(CASE_TYPE))
    out = out.withColumn("similar_cases", F.coalesce(F.col("similar_cases"), F.array().cast(CASE_TYPE)))
    if narratives is not None:
        out = out.join(narratives, key, "left")
    else:
        out = out.withColumn("underwriter_narrative", F.lit(None).cast("string"))
    out = out.withColumn("underwriter_narrative", F.coalesce(F.col("underwriter_narrative"), F.lit("")))
    if checks is not None:
        out = out.join(checks, key, "left")
    else:
        out = out.withColumn("hallucination_check", F.lit(None).cast(CHECK_TYPE))
    return out


def stage_trace(stages: DataFrame, key: str = "submission_id", stage: str = "stage", ms: str = "ms") -> DataFrame:
    """O-J3: stage times side by side (ingestion, prediction, rag, llm), the
    total of the known ones and whether any is missing."""
    names = ["ingestion", "prediction", "rag", "llm"]
    wide = stages.groupBy(key).pivot(stage, names).agg(F.sum(ms))
    cols = [F.col(n).cast("double").alias(f"{n}_ms") for n in names]
    wide = wide.select(key, *cols)
    total = sum(F.coalesce(F.col(f"{n}_ms"), F.lit(0.0)) for n in names)
    missing = F.lit(False)
    for n in names:
        missing = missing | F.col(f"{n}_ms").isNull()
    return wide.withColumn("total_ms", total).withColumn("has_missing_stage", missing)


def audit_events(analysis: DataFrame, provider: Column | str, request_id: Column | None = None,
                 timestamp: Column | None = None, key: str = "submission_id") -> DataFrame:
    """O-S6: one flat audit record per assessment (12 fields)."""
    prov = F.lit(provider) if isinstance(provider, str) else provider
    hc = F.col("hallucination_check")
    return analysis.select(
        (timestamp if timestamp is not None else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"))
        .alias("timestamp"),
        (request_id if request_id is not None else F.expr("uuid()")).alias("request_id"),
        F.col(key).cast("string").alias("submission_id"),
        F.col("risk_tier").alias("risk_tier"),
        F.col("risk_probability").alias("risk_probability"),
        F.col("predicted_claim_amount").alias("predicted_claim_amount"),
        F.col("confidence_score").alias("confidence_score"),
        F.col("processing_time_ms").cast("double").alias("processing_time_ms"),
        F.size(F.coalesce(F.col("similar_cases"), F.array().cast(CASE_TYPE))).alias("similar_cases_count"),
        hc["detected"].alias("hallucination_detected"),
        hc["confidence"].alias("hallucination_confidence"),
        prov.alias("provider"),
    )


def write_audit(audit: DataFrame, path: str, fmt: str = "json") -> None:
    """Append audit records (directories are created by the writer)."""
    audit.write.mode("append").format(fmt).save(path)


def narrative_context(df: DataFrame, key: str = "submission_id", max_text: int = 2000) -> DataFrame:
    """O-T13: the generator's input per submission: entities, the first 2000
    characters of the text, the prediction and the neighbours as JSON."""
    from ..functions.text import narrative_context as ctx

    pred = F.to_json(F.struct("risk_tier", "risk_probability", "predicted_claim_amount", "confidence_score",
                              "key_risk_factors"))
    return df.select(
        key,
        ctx(F.to_json(F.col("entities")), F.coalesce(F.col("full_text"), F.lit("")), pred,
            F.to_json(F.col("similar_cases")), max_text).alias("context"),
    )


def judge_context(df: DataFrame, key: str = "submission_id") -> DataFrame:
    """O-T14: the auditor's input: source facts plus the narrative to check."""
    facts = F.to_json(F.struct(
        F.col("entities").alias("entity_summary"), "risk_tier", "risk_probability", "predicted_claim_amount",
        F.col("key_risk_factors").alias("risk_factors"), "similar_cases",
    ))
    return df.select(key, F.concat(F.lit("Source data: "), facts, F.lit("\n\nNarrative:\n"),
                                   F.coalesce(F.col("underwriter_narrative"), F.lit(""))).alias("judge_context"))


def linear_scorer(probability: LinearModel, severity: LinearModel):
    """Scores by two linear models: the logistic of the first margin, the second
    margin as the amount; the factors are the first one's contributions."""

    def run(feats: DataFrame, key: str, keep: Iterable[str] = ()) -> DataFrame:
        rows = feats.select(key, *keep, probability.contributions().alias("shap_values"),
                            severity.contributions().alias("_amount"))
        return rows.select(
            key, *keep, (1.0 / (1.0 + F.exp(-probability.margin(F.col("shap_values"))))).alias("raw_probability"),
            severity.margin(F.col("_amount")).alias("raw_amount"), "shap_values",
        )

    return run


def tree_scorer(probability_model, severity_model, explain_path: str):
    """Scores by the two fitted boosted-tree pipelines, with tree attributions."""

    def run(feats: DataFrame, key: str) -> DataFrame:
        from .explain import collect_values
        from .scoring import model_scores
        from .tree_explain import explain_trees

        values = collect_values(explain_trees(feats, probability_model.stages[-1], key, explain_path), key)
        return model_scores(feats, probability_model, severity_model, key).join(values, key, "left")

    return run


def assess(pages: DataFrame, cases: DataFrame, scorer, k: int = vocab.DEFAULT_TOP_K,
           threshold: float = vocab.SEARCH_THRESHOLD, dim: int = 384, key: str = "doc_id",
           submissions: DataFrame | None = None, narratives: DataFrame | None = None,
           exact: bool = False, cells: dict | None = None) -> DataFrame:
    """O-J5: pages -> entities -> summary -> features -> score, tier and factors
    -> hashed entity text -> top-k similar cases -> assessment and quality
    checks.  ``cases``: a stored ``CaseIndex`` (nothing is fitted then), or a table
    of case_id, policy_id, summary, outcome, vector.

    Every document of ``submissions`` (else of ``pages``) gets a row: one without
    any entity scores the empty summary and searches the empty submission.
    ``scorer`` (``linear_scorer``, ``tree_scorer``) carries its models' own terms,
    so a document's row does not depend on the others.  Search visits inverted
    lists (``cells``: its options); ``exact`` costs |submissions| x |cases| dot
    products."""
    from ..functions.text import entities_to_text
    from .entities import dedup_entities, extract_entities, summarize_entities
    from .explain import factor_list, ranked_factors
    from .features import features
    from .quality import quality_checks
    from .scoring import score
    from .case_index import CaseIndex
    from .vectors import hash_embed, similar_cases, similar_cases_ann

    found = summarize_entities(dedup_entities(extract_entities(pages, key, clean=True, offsets=False, nested=True), key), key)
    every = (pages if submissions is None else submissions).select(key).distinct()
    empty = F.create_map().cast("map<string,array<string>>")
    # two branches below (features and retrieval) start here: write it once
    summ = staged(every.join(found.select(key, "entity_summary"), key, "left").select(
        key, F.coalesce("entity_summary", empty).alias("entity_summary")), "summaries")
    scored = score(scorer(features(summ, keep=[key]), key)).withColumn(
        "key_risk_factors", factor_list(ranked_factors(F.col("shap_values"))))
    pred = scored.select(key, "risk_tier", "risk_probability", "predicted_claim_amount", "confidence_score")
    fac = scored.select(key, "key_risk_factors")
    qv = hash_embed(summ.select(key, entities_to_text("entity_summary").alias("_txt")), key, "_txt", dim)
    if isinstance(cases, CaseIndex):
        nb = cases.search(qv, k, threshold, query_key=key, probes=cases.n_cells if exact else None)
        cases = cases.cases()
    elif exact:
        nb = similar_cases(qv, cases, k, threshold, query_key=key)
    else:
        nb = similar_cases_ann(qv, cases, k, threshold, query_key=key, **(cells or {}))
    meta = cases.select("case_id", "policy_id", "summary", "outcome")
    nbl = nb.join(meta, "case_id").groupBy(F.col("query_id").alias(key)).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "policy_id", "similarity_score", "summary",
                                                         "outcome"))),
                    lambda c: F.struct(c["policy_id"].alias("policy_id"),
                                       c["similarity_score"].alias("similarity_score"),
                                       c["summary"].alias("summary"), c["outcome"].alias("outcome")))
        .alias("similar_cases")
    )
    subs = summ.select(key, F.col("entity_summary").alias("entities"))
    out = assemble_analysis(subs, pred, fac, nbl, narratives, None, key)
    return out.join(quality_checks(out, key), key, "left")
