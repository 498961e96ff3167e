"""Job compositions matching the reference's entry points,
each a lazy DataFrame plan over whole tables:

* ``extract``          page text -> documents with entity summaries
* ``predict``          summaries -> features -> scores, tier, attributions
* ``search``           summaries -> entity text -> vectors -> similar cases
* ``train_models``     claims -> features -> exact split -> two GBT models + metrics
* ``build_case_index`` claims -> case records + vectors (optionally stored)
* ``index_filings``    filing texts -> chunks -> entities -> case records appended
* ``run_evaluation``   claims -> stratified cases -> per-case checks -> metrics
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import vocab
from ..functions.text import brief, entities_to_text, index_text
from ..operators import claims as oc
from ..operators import entities as oe
from ..operators import evaluate as ev
from ..operators import explain as ox
from ..operators import features as of
from ..operators import scoring as om
from ..operators import text as ot
from ..operators import vectors as ov


def extract(files: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """POST /extract as a table job: O-T1 -> O-N1..N5 -> O-N7."""
    return oe.assemble_documents(files, pages, key)


def predict(summaries: DataFrame, probability_model, severity_model, key: str = "submission_id",
            explain_path: str | None = None) -> DataFrame:
    """POST /predict: features, both models, tier/rounding, and the top-5
    factors (tree attributions when ``explain_path`` is given)."""
    feats = of.features(summaries.select(key, "entity_summary"), keep=[key])
    scored = om.score(om.model_scores(feats, probability_model, severity_model, key))
    out = scored.select(key, "risk_tier", "risk_probability", "predicted_claim_amount", "confidence_score")
    if explain_path is not None:
        from ..operators.tree_explain import explain_trees

        phi = explain_trees(feats, probability_model.stages[-1], key, explain_path)
        values = ox.collect_values(phi, key)
        out = out.join(values.select(key, ox.factor_list(ox.ranked_factors(F.col("shap_values"))).alias("key_risk_factors")), key, "left")
    return out


def search(summaries: DataFrame, cases: DataFrame, k: int = vocab.DEFAULT_TOP_K,
           threshold: float = vocab.SEARCH_THRESHOLD, key: str = "submission_id", dim: int = 384,
           exact: bool = False, cells: dict | None = None) -> DataFrame:
    """POST /search: O-T9 -> O-V1 -> O-V5 (or O-V4 when ``exact``) -> O-V7 ->
    O-V8; ``cases`` carries case_id, policy_id, summary, outcome, vector.
    ``cells``: options of the inverted-list search."""
    text = summaries.select(key, entities_to_text("entity_summary").alias("query_text"))
    qv = ov.hash_embed(text, key, "query_text", dim)
    if exact:
        nb = ov.similar_cases(qv, cases, k, threshold, query_key=key)
    else:
        nb = ov.similar_cases_ann(qv, cases, k, threshold, query_key=key, **(cells or {}))
    meta = cases.select("case_id", "policy_id", "summary", "outcome")
    joined = ov.case_join(nb.withColumnRenamed("query_id", key), meta)
    total = cases.agg(F.count(F.lit(1))).first()[0]
    return ov.search_response(text, joined, F.lit(total).cast("bigint"), key)


def train_models(claims: DataFrame, max_iter: int = 200, max_depth: int = 6, seed: int = 42,
                 model_path: str | None = None):
    """scripts.train: O-C1 -> O-F0 -> O-M1 -> O-M2/M3 -> O-M4/M5 (-> O-M14).
    Returns (probability model, severity model, AUC table, RMSE/MAE table)."""
    table = of.features(oc.claim_entities(claims, "train"), keep=["case_id"]).join(oc.claim_targets(claims), "case_id")
    split = om.train_test_split(table, "case_id", 0.8, seed)
    train, test = split.where("is_train"), split.where("NOT is_train")
    p = om.fit_probability(train, max_iter=max_iter, max_depth=max_depth, seed=seed)
    s = om.fit_severity(train, max_iter=max_iter, max_depth=max_depth, seed=seed)
    scored = om.model_scores(test, p, s, "case_id").join(test.select("case_id", "severe", "claim_amount"), "case_id")
    auc = om.roc_auc(scored.select(F.col("raw_probability").alias("score"), F.col("severe").alias("label")))
    reg = om.regression_metrics(scored.select(F.col("raw_amount").alias("prediction"),
                                              F.col("claim_amount").alias("label")))
    if model_path:
        om.save_models(p, s, model_path)
    return p, s, auc, reg


def build_case_index(claims: DataFrame, dim: int = 384, path: str | None = None) -> DataFrame:
    """scripts.build_case_index: O-C2/O-C3 -> O-T9 -> O-V1 (-> O-S5)."""
    ents = oc.claim_entities(claims, "index").select("case_id", entities_to_text("entity_summary").alias("_t"))
    cases = oc.claim_cases(claims).join(ov.hash_embed(ents, "case_id", "_t", dim), "case_id")
    if path:
        from ..sources.case_store import write_cases

        write_cases(cases, path)
    return cases


def filing_cases(filings: DataFrame, company: str = "company", order: str = "doc_id", text: str = "text",
                 offset: int = vocab.FILING_CASE_ID_OFFSET) -> DataFrame:
    """scripts.index_edgar up to the vectors: O-T6 -> O-T7 -> entities per chunk
    (summarised without the dedup step) -> O-T8 brief -> O-T9/O-T10 text to embed."""
    chunks = ot.chunk_text(filings.select(order, text), order, text).join(filings.select(order, company), order)
    cases = ot.chunk_cases(chunks, company, order, offset)
    ents = oe.extract_entities(cases.select("case_id", F.lit(0).alias("page_number"), F.col("chunk").alias("text")),
                               "case_id", offsets=False)
    summ = oe.summarize_without_dedup(ents, "case_id")
    out = cases.join(summ, "case_id", "left").withColumn(
        "summary_entries", F.coalesce("summary_entries", F.array().cast("array<struct<label:string,values:array<string>>>"))
    ).withColumn(
        "entity_summary", F.coalesce("entity_summary", F.create_map().cast("map<string,array<string>>"))
    )
    return out.select(
        "case_id", "policy_id", brief("summary_entries", "chunk").alias("summary"), "outcome", "risk_tier",
        "claim_amount", company, order, "chunk_no",
        index_text(entities_to_text("entity_summary"), "chunk").alias("index_text"),
    )


def index_filings(filings: DataFrame, existing_cases: DataFrame, dim: int = 384, **kw) -> DataFrame:
    """scripts.index_edgar: filing cases embedded and appended after the
    existing cases (O-V6)."""
    fc = filing_cases(filings, offset=0, **kw)
    vec = ov.hash_embed(fc, "case_id", "index_text", dim)
    new = fc.join(vec, "case_id").select("case_id", "policy_id", "summary", "outcome", "risk_tier", "claim_amount",
                                         "vector")
    return ov.append_cases(existing_cases, new, "case_id", source="filings")


def run_evaluation(claims: DataFrame, predictions: DataFrame, n_per_severity: int = 5, seed: int = 42,
                   ids: list[int] | None = None):
    """scripts.eval: O-W4 (or O-J4 explicit ids) -> O-Q16 -> O-Q17 -> O-Q18.
    ``predictions``: case_id, risk_tier, risk_probability,
    predicted_claim_amount, key_risk_factors, similar_cases, processing_time_ms.
    Returns (metrics, cases, confusion)."""
    cols = ["case_id", "incident_type", "incident_severity", "fraud_reported", "total_claim_amount"]
    base = claims.select(*cols)
    picked = ev.pick_cases(base, ids) if ids else ev.stratified_sample(base, n=n_per_severity, seed=seed).select(*cols)
    cases = ev.evaluate_cases(picked, predictions, predictions)
    return ev.eval_metrics(cases), cases, ev.confusion(cases)
