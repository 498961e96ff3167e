"""O-Q12..O-Q21, O-W4: stratified case selection and evaluation metrics.

Selection is a per-stratum top-n (``row_number`` <= n), which Spark plans
with a partial ``WindowGroupLimit`` before the shuffle, so even a stratum
holding most rows sends only n rows per map task.  Everything else is
per-row expressions and global aggregates.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.core import js_round, lookup
from .scoring import split_hash


def stratified_sample(df: DataFrame, key: str = "case_id", strata: str = "incident_severity",
                      strata_order=tuple(vocab.SEVERITY_STRATA), fraud: Column | None = None,
                      n: int = 5, seed: int = 42) -> DataFrame:
    """O-W4: per stratum (in ``strata_order``; other strata ignored) the first
    flagged row of the seeded shuffle, then unflagged rows in shuffle order,
    then the remaining flagged rows; n per stratum.  Adds ``stratum_no`` and
    ``pick_no``."""
    fraud = F.col("fraud_reported") == "Y" if fraud is None else fraud
    order_map = {s: i for i, s in enumerate(strata_order)}
    base = df.where(F.col(strata).isin(*strata_order)).withColumns(
        {"_h": split_hash(key, seed), "_fr": F.coalesce(fraud, F.lit(False)),
         "stratum_no": lookup(order_map, F.col(strata)).cast("int")}
    )
    first_fraud = base.where("_fr").groupBy("stratum_no").agg(
        F.min(F.struct("_h", key)).alias("_ff")
    )
    # one row per stratum: a bounded table (len(strata_order) rows)
    with_first = base.join(F.broadcast(first_fraud), "stratum_no", "left")
    is_first = F.col("_fr") & (F.struct("_h", key) == F.col("_ff"))
    priority = F.when(is_first, 0).when(~F.col("_fr"), 1).otherwise(2)
    w = Window.partitionBy("stratum_no").orderBy(priority, "_h", key)
    picked = with_first.withColumn("pick_no", F.row_number().over(w)).where(F.col("pick_no") <= n)
    return picked.drop("_h", "_fr", "_ff")


def pick_cases(df: DataFrame, ids: list[int] | None, key: str = "case_id") -> DataFrame:
    """O-J4: explicit ids override the selection; ids that do not exist are
    ignored (semi-join against a literal list, a bounded broadcast)."""
    if not ids:
        return df
    spark = df.sparkSession
    wanted = spark.createDataFrame([(int(i),) for i in ids], f"{key} bigint")
    return df.join(F.broadcast(wanted), key, "left_semi")


def tier_rank(tier: Column) -> Column:
    return lookup(vocab.TIER_ORDER, tier, -1)


def tier_adjacent(expected: Column, predicted: Column) -> Column:
    """O-Q12: ordinal distance <= 1; unknown tiers count as -1."""
    return F.abs(tier_rank(expected) - tier_rank(predicted)) <= 1


def claim_reasonable(predicted: Column, actual: Column, lo: float = 0.05, hi: float = 20.0) -> Column:
    """O-Q13: predicted > 0, and when actual > 0 the ratio lies in [lo, hi]."""
    ratio = predicted / actual
    return F.when(predicted <= 0, F.lit(False)).when(actual <= 0, predicted > 0).otherwise(
        (ratio >= lo) & (ratio <= hi)
    )


def neighbour_type_match(cases: Column, incident_type: Column) -> Column:
    """O-Q14: some neighbour summary contains the incident type (lower case)."""
    kw = F.lower(F.coalesce(incident_type, F.lit("")))
    return F.exists(cases, lambda c: F.lower(F.coalesce(c["summary"], F.lit(""))).contains(kw))


def evaluate_cases(cases: DataFrame, predictions: DataFrame, predictions_again: DataFrame,
                   key: str = "case_id") -> DataFrame:
    """O-Q15/O-Q16: one row per evaluated case with all checks and a status.

    ``cases``: key, incident_type, incident_severity, fraud_reported,
    total_claim_amount.  ``predictions`` / ``predictions_again``: key,
    risk_tier, risk_probability, predicted_claim_amount, key_risk_factors,
    similar_cases, processing_time_ms (two runs for the consistency check).
    """
    from .quality import factors_valid_exact

    again = predictions_again.select(
        key, F.col("risk_probability").alias("_p2"), F.col("predicted_claim_amount").alias("_a2")
    )
    j = cases.join(predictions, key, "left").join(again, key, "left")
    expected = lookup(vocab.SEVERITY_TO_TIER, F.coalesce(F.col("incident_severity"), F.lit("")), "MODERATE")
    predicted = F.coalesce(F.col("risk_tier"), F.lit(""))
    prob = F.coalesce(F.col("risk_probability"), F.lit(0.0))
    amount = F.coalesce(F.col("predicted_claim_amount"), F.lit(0.0))
    actual = F.coalesce(F.nullif(F.col("total_claim_amount").cast("string"), F.lit("")).try_cast("double"),
                        F.lit(0.0))
    sims = F.coalesce(F.col("similar_cases"), F.array().cast("array<struct<policy_id:string,similarity_score:double,summary:string,outcome:string>>"))
    out = j.select(
        F.col(key).alias("case_index"),
        F.coalesce(F.col("incident_type"), F.lit("")).alias("incident_type"),
        F.coalesce(F.col("incident_severity"), F.lit("")).alias("incident_severity"),
        F.coalesce(F.col("fraud_reported"), F.lit("")).alias("fraud_reported"),
        actual.alias("actual_claim_amount"),
        expected.alias("expected_tier"),
        predicted.alias("predicted_tier"),
        prob.alias("risk_probability"),
        amount.alias("predicted_claim_amount"),
        F.size(sims).cast("bigint").alias("rag_result_count"),
        F.coalesce(F.get(sims, 0)["similarity_score"], F.lit(0.0)).alias("rag_top_similarity"),
        neighbour_type_match(sims, F.col("incident_type")).alias("rag_type_match"),
        (predicted == expected).alias("tier_match"),
        tier_adjacent(expected, predicted).alias("tier_adjacent"),
        claim_reasonable(amount, actual).alias("claim_reasonable"),
        (F.coalesce(F.col("_p2"), F.lit(-1.0)) == prob) & (F.coalesce(F.col("_a2"), F.lit(-1.0)) == amount),
        factors_valid_exact(F.coalesce(F.col("key_risk_factors"),
                                       F.array().cast("array<struct<name:string,shap_value:double,direction:string>>"))),
        F.col("processing_time_ms").cast("double").alias("processing_time_ms"),
    ).toDF(
        "case_index", "incident_type", "incident_severity", "fraud_reported", "actual_claim_amount",
        "expected_tier", "predicted_tier", "risk_probability", "predicted_claim_amount", "rag_result_count",
        "rag_top_similarity", "rag_type_match", "tier_match", "tier_adjacent", "claim_reasonable",
        "consistency_passed", "shap_grounded", "processing_time_ms",
    )
    return out.withColumn(
        "status",
        F.when(F.col("tier_match"), F.lit("PASS")).when(F.col("tier_adjacent"), F.lit("~")).otherwise(F.lit("FAIL")),
    )


def eval_metrics(results: DataFrame) -> DataFrame:
    """O-Q17: the report's aggregates in one global aggregate; both means of
    the top similarity (over all cases, as saved, and over cases with
    results, as printed)."""
    n = F.count(F.lit(1))
    return results.agg(
        n.cast("bigint").alias("total_cases"),
        F.count_if("tier_match").cast("bigint").alias("tier_exact_match"),
        F.count_if("tier_adjacent").cast("bigint").alias("tier_adjacent_match"),
        F.count_if("consistency_passed").cast("bigint").alias("consistency_passed"),
        F.count_if("shap_grounded").cast("bigint").alias("shap_grounded"),
        F.count_if("claim_reasonable").cast("bigint").alias("claim_reasonable"),
        F.count_if("rag_type_match").cast("bigint").alias("rag_type_match"),
        F.round(F.coalesce(F.sum("rag_top_similarity") / n, F.lit(0.0)), 4).alias("mean_rag_similarity"),
        F.round(F.coalesce(F.avg(F.when(F.col("rag_result_count") > 0, F.col("rag_top_similarity"))), F.lit(0.0)), 4)
        .alias("mean_rag_similarity_with_results"),
        F.round(F.coalesce(F.sum("processing_time_ms") / n, F.lit(0.0)), 1).alias("mean_processing_time_ms"),
    )


def confusion(results: DataFrame) -> DataFrame:
    """O-Q18: expected x predicted tier counts (long form; ``pivot`` for a grid)."""
    return results.groupBy("expected_tier", "predicted_tier").agg(F.count(F.lit(1)).cast("bigint").alias("n"))


def first_of_each_tier(results: DataFrame, key: str = "case_index") -> DataFrame:
    """(bucket, key): the first HIGH/CRITICAL, first MODERATE and first LOW case
    by ``case_order``; at most three rows."""
    bucket = (
        F.when(F.col("predicted_tier").isin("HIGH", "CRITICAL"), F.lit("high"))
        .when(F.col("predicted_tier") == "MODERATE", F.lit("moderate"))
        .when(F.col("predicted_tier") == "LOW", F.lit("low"))
    )
    return results.where(bucket.isNotNull()).groupBy(bucket.alias("bucket")).agg(
        F.min(F.struct("case_order", key)).alias("_f")
    ).select("bucket", F.col(f"_f.{key}").alias(key))


def narrative_eval(results: DataFrame, narratives: DataFrame, key: str = "case_index") -> DataFrame:
    """O-Q19: the first HIGH/CRITICAL, first MODERATE and first LOW case (in
    case order) with narrative length, tier agreement and factor reference
    (a factor name found in the narrative, case-insensitive)."""
    firsts = first_of_each_tier(results, key)
    j = firsts.join(results, key).join(narratives, key, "left")
    narr = F.coalesce(F.col("underwriter_narrative"), F.lit(""))
    names = F.transform(F.coalesce(F.col("key_risk_factors"), F.array().cast(
        "array<struct<name:string,shap_value:double,direction:string>>")), lambda f: F.coalesce(f["name"], F.lit("")))
    return j.select(
        "bucket", key,
        F.length(narr).cast("bigint").alias("narrative_length"),
        (F.coalesce(F.col("narrative_tier"), F.lit("")) == F.col("predicted_tier")).alias("tier_matches_prediction"),
        F.exists(names, lambda n: (n != "") & F.lower(narr).contains(F.lower(n))).alias("references_shap_factor"),
    )


def hallucination_rate(checks: DataFrame, flag: str = "detected") -> DataFrame:
    """O-Q20 / O-A5: flagged count, total and share (percent)."""
    return checks.agg(
        F.count_if(F.col(flag)).cast("bigint").alias("flagged"),
        F.count(F.lit(1)).cast("bigint").alias("total"),
        F.round(F.coalesce(F.avg(F.col(flag).cast("double")) * 100, F.lit(0.0)), 6).alias("rate_pct"),
    )


def eval_display(metrics: DataFrame) -> DataFrame:
    """O-Q21: each count metric as a percent of the cases with a band
    (100 -> good, >= 50 -> fair, else poor)."""
    names = ["tier_exact_match", "tier_adjacent_match", "consistency_passed", "shap_grounded"]
    stack = ", ".join(f"'{n}', CAST({n} AS DOUBLE)" for n in names)
    long = metrics.select("total_cases", F.expr(f"stack({len(names)}, {stack}) AS (metric, value)"))
    pct = F.when(F.col("total_cases") > 0, js_round(F.col("value") / F.col("total_cases") * 100)).otherwise(F.lit(0))
    return long.select(
        "metric", F.col("value").cast("bigint").alias("value"), pct.cast("bigint").alias("percent"),
        F.when(pct >= 100, F.lit("good")).when(pct >= 50, F.lit("fair")).otherwise(F.lit("poor")).alias("band"),
    )
