"""The job compositions end to end on the smallest tables."""

from pyspark.sql import functions as F

from riskflow.operators import entities as oe
from riskflow.plans import jobs, views

from .conftest import SF_SMALL


def test_train_predict_search_evaluate(spark, tmp_dir):
    claims = views.claims(spark, SF_SMALL)
    p, s, auc, reg = jobs.train_models(claims, max_iter=3, max_depth=3, model_path=f"{tmp_dir}/models")
    a = auc.first()
    assert a["n_pos"] + a["n_neg"] == claims.count() - int(claims.count() * 0.8)
    assert reg.first()["rmse"] >= 0

    pages = views.submission_pages(spark, SF_SMALL)
    summ = oe.summarize_entities(oe.dedup_entities(oe.extract_entities(pages, clean=True, offsets=False)))
    summ = summ.withColumnRenamed("doc_id", "submission_id")
    pred = jobs.predict(summ, p, s, "submission_id", explain_path=f"{tmp_dir}/gbt").collect()
    assert pred and all(r["risk_tier"] in ("LOW", "MODERATE", "HIGH", "CRITICAL") for r in pred)
    assert all(len(r["key_risk_factors"]) <= 5 for r in pred if r["key_risk_factors"] is not None)

    cases = jobs.build_case_index(claims, dim=64, path=f"{tmp_dir}/cases")
    resp = jobs.search(summ, cases, k=3, threshold=0.0, dim=64).collect()
    n_claims = claims.count()
    assert len(resp) == summ.count()
    assert all(r["total_indexed"] == n_claims and len(r["results"]) <= 3 for r in resp)

    preds = views.analysis(spark, SF_SMALL).select(
        F.col("submission_id").alias("case_id"), "risk_tier", "risk_probability", "predicted_claim_amount",
        "key_risk_factors", "similar_cases", F.lit(10.0).alias("processing_time_ms"))
    metrics, per_case, conf = jobs.run_evaluation(claims, preds)
    assert metrics.first()["total_cases"] == per_case.count() <= 20
    m2, c2, _ = jobs.run_evaluation(claims, preds, ids=[1, 2, 3, 10**12])
    assert c2.count() == claims.where(F.col("case_id").isin(1, 2, 3)).count()


def test_assessment_does_not_depend_on_the_batch(spark):
    from riskflow.operators import assemble as oa
    from riskflow.plans.q_quality import LINEAR_MODEL, SEVERITY_MODEL

    pages = spark.createDataFrame(
        [(1, 0, "Loss history: fire and flood. Premium amount is $5,000."), (2, 0, "Nothing of note here."),
         (3, 0, "Coverage requested: general liability, limit $2 million."), (4, 0, "")],
        "doc_id long, page_number int, text string")
    cases = jobs.build_case_index(views.claims(spark, SF_SMALL), dim=32)
    scorer = oa.linear_scorer(LINEAR_MODEL, SEVERITY_MODEL)
    cols = ["risk_tier", "risk_probability", "predicted_claim_amount", "n"]

    def rows(df):
        out = oa.assess(df, cases, scorer, dim=32, exact=True, submissions=df)
        return {r["doc_id"]: [r[c] for c in cols] for r in out.withColumn("n", F.size("similar_cases")).collect()}

    together = rows(pages)
    assert set(together) == {1, 2, 3, 4}  # documents without an entity stay
    assert together[2] == together[4] and together[1] != together[2]
    for i in (1, 2):
        assert rows(pages.where(f"doc_id = {i}"))[i] == together[i]


def test_index_filings_appends_after_claims(spark):
    claims = views.claims(spark, SF_SMALL)
    cases = jobs.build_case_index(claims, dim=32)
    docs = views.table(spark, SF_SMALL, "documents").select("doc_id", "text", F.col("source").alias("company"))
    both = jobs.index_filings(docs, cases.withColumn("source", F.lit("claims")), dim=32)
    top = cases.agg(F.max("case_id")).first()[0]
    new = both.where(F.col("source") == "filings")
    assert new.agg(F.min("case_id")).first()[0] == top + 1
    assert both.select("case_id").distinct().count() == both.count()
