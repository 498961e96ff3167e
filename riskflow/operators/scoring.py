"""O-M1..O-M7, O-M14: split, train, evaluate, score, tier, model store.

Models are ``pyspark.ml`` gradient-boosted trees (the boosted-tree library
of the original is not available) or logistic regression as the linear
option.  Scoring is ``model.transform`` (a narrow projection); tiers and
rounding are plain column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.core import col

# ---------------------------------------------------------------------------
# O-M7 / O-M6
# ---------------------------------------------------------------------------


def risk_tier(probability: Column | str, thresholds=vocab.TIER_THRESHOLDS) -> Column:
    """Half-open cuts on the *unrounded* probability: [0,.25) LOW, [.25,.5)
    MODERATE, [.5,.75) HIGH, [.75,1] CRITICAL."""
    p = col(probability)
    low, mid, high = thresholds
    return (
        F.when(p < low, F.lit("LOW"))
        .when(p < mid, F.lit("MODERATE"))
        .when(p < high, F.lit("HIGH"))
        .otherwise(F.lit("CRITICAL"))
    )


def score(
    df: DataFrame,
    probability: str = "raw_probability",
    amount: str = "raw_amount",
    thresholds=vocab.TIER_THRESHOLDS,
) -> DataFrame:
    """Prediction columns from a probability and an amount column: amount
    clamped at 0, tier from the unrounded probability, confidence
    |p - 0.5| * 2, then rounding (4 dp probability/confidence, 2 dp amount)."""
    p = F.col(probability).cast("double")
    return df.withColumns(
        {
            "risk_tier": risk_tier(p, thresholds),
            "risk_probability": F.round(p, 4),
            "predicted_claim_amount": F.round(F.greatest(F.col(amount).cast("double"), F.lit(0.0)), 2),
            "confidence_score": F.round(F.abs(p - F.lit(0.5)) * F.lit(2.0), 4),
        }
    )


def model_scores(features_df: DataFrame, probability_model, severity_model, key: str) -> DataFrame:
    """Run both fitted pipelines one after the other over the same rows; returns
    (key, raw_probability, raw_amount)."""
    from pyspark.ml.functions import vector_to_array

    rows = probability_model.transform(features_df).withColumn(
        "raw_probability", F.get(vector_to_array(F.col("probability")), 1)
    ).drop("features", "rawPrediction", "probability", "prediction")
    return severity_model.transform(rows).select(key, "raw_probability", F.col("prediction").alias("raw_amount"))


# ---------------------------------------------------------------------------
# O-M1: seeded, exact 80/20 split without a global sort
# ---------------------------------------------------------------------------

_BUCKET_SHIFT = 12  # 2^32 hash space -> 2^20 buckets


def split_hash(key: Column | str, seed: int) -> Column:
    """First 32 bits of md5(seed || key) as a BIGINT (same in DuckDB)."""
    return F.conv(
        F.substring(F.md5(F.concat(F.lit(str(seed)), col(key).cast("string"))), 1, 8), 16, 10
    ).cast("bigint")


def train_test_split(df: DataFrame, key: str, fraction: float = 0.8, seed: int = 42) -> DataFrame:
    """Adds ``is_train``: exactly floor(fraction * n) rows, the ones first in
    (hash, key) order.  Two small aggregates find the boundary bucket (at most
    2^20 rows of counts); only the rows of that one bucket are ranked."""
    h = split_hash(key, seed)
    hashed = df.withColumn("_h", h).withColumn("_b", F.shiftright(F.col("_h"), _BUCKET_SHIFT))
    counts = hashed.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    cum = counts.withColumn(
        "_cum", F.sum("_n").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0))
    )
    total = counts.agg(F.sum("_n")).first()[0] or 0
    target = int(total * fraction)
    boundary = cum.where(F.col("_cum") >= target).orderBy("_b").select("_b", "_n", "_cum").first()
    if target == 0 or boundary is None:
        return df.withColumn("is_train", F.lit(target >= total and total > 0))
    b_star, n_star, cum_star = boundary
    remaining = target - (cum_star - n_star)
    # Rows outside the boundary bucket are decided by their bucket alone; only
    # the boundary bucket (about n / 2^20 rows) is ranked.
    outside = hashed.where(F.col("_b") != b_star).withColumn("is_train", F.col("_b") < b_star)
    inside = hashed.where(F.col("_b") == b_star).withColumn(
        "is_train", F.row_number().over(Window.orderBy("_h", key)) <= remaining
    )
    return outside.unionByName(inside).drop("_h", "_b")


# ---------------------------------------------------------------------------
# O-M2 / O-M3 / O-M14: training and the model store
# ---------------------------------------------------------------------------


def fit_probability(train: DataFrame, label: str = "severe", max_iter: int = 200, max_depth: int = 6,
                    step_size: float = 0.1, seed: int = 42, linear: bool = False):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier, LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    assembler = VectorAssembler(inputCols=vocab.FEATURE_NAMES, outputCol="features")
    if linear:
        est = LogisticRegression(featuresCol="features", labelCol=label, maxIter=max_iter)
    else:
        est = GBTClassifier(
            featuresCol="features", labelCol=label, maxIter=max_iter, maxDepth=max_depth,
            stepSize=step_size, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
        )
    return Pipeline(stages=[assembler, est]).fit(train)


def fit_severity(train: DataFrame, label: str = "claim_amount", max_iter: int = 200, max_depth: int = 6,
                 step_size: float = 0.1, seed: int = 42):
    from pyspark.ml import Pipeline
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    assembler = VectorAssembler(inputCols=vocab.FEATURE_NAMES, outputCol="features")
    est = GBTRegressor(
        featuresCol="features", labelCol=label, lossType="squared", maxIter=max_iter, maxDepth=max_depth,
        stepSize=step_size, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed,
    )
    return Pipeline(stages=[assembler, est]).fit(train)


def save_models(probability_model, severity_model, path: str) -> None:
    probability_model.write().overwrite().save(f"{path}/claim_probability")
    severity_model.write().overwrite().save(f"{path}/claim_severity")


def load_models(path: str):
    """Missing path is an error (as in the original service start-up)."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(f"{path}/claim_probability"), PipelineModel.load(f"{path}/claim_severity")


# ---------------------------------------------------------------------------
# O-M4 / O-M5: evaluation metrics
# ---------------------------------------------------------------------------


AUC_BUCKETS = 1024


def roc_auc(df: DataFrame, score_col: str = "score", label_col: str = "label") -> DataFrame:
    """Exact ROC AUC by the rank-sum rule with average ranks for ties.

    Scores are first reduced to distinct values (partial aggregation), then
    given global ranks through a two-level prefix sum: ``AUC_BUCKETS`` coarse
    buckets cut at quantiles of the distinct scores, so clustered scores spread
    over all of them, and a running sum inside each bucket.  No step holds all
    rows in one task.
    """
    import math

    from pyspark.ml.feature import Bucketizer

    s = F.col(score_col).cast("double")
    y = F.col(label_col).cast("double")
    per_score = df.groupBy(s.alias("s")).agg(
        F.sum(y).alias("pos"), F.count(F.lit(1)).alias("cnt")
    )
    steps = [i / AUC_BUCKETS for i in range(1, AUC_BUCKETS)]
    cuts = per_score.agg(F.percentile_approx("s", steps, 10 * AUC_BUCKETS)).first()[0] or []
    splits = [-math.inf, *sorted(set(cuts)), math.inf]  # at most AUC_BUCKETS numbers
    per_score = Bucketizer(splits=splits, inputCol="s", outputCol="cb").transform(per_score)
    bucket_tot = per_score.groupBy("cb").agg(F.sum("cnt").alias("bcnt"))
    offsets = bucket_tot.withColumn(
        "before", F.sum("bcnt").over(Window.orderBy("cb").rowsBetween(Window.unboundedPreceding, -1))
    ).select("cb", F.coalesce(F.col("before"), F.lit(0)).alias("before"))
    w = Window.partitionBy("cb").orderBy("s").rowsBetween(Window.unboundedPreceding, -1)
    ranked = (
        per_score.withColumn("within", F.coalesce(F.sum("cnt").over(w), F.lit(0)))
        .join(F.broadcast(offsets), "cb")
        .withColumn("avg_rank", F.col("before") + F.col("within") + (F.col("cnt") + 1) / 2.0)
    )
    agg = ranked.agg(
        F.sum(F.col("pos") * F.col("avg_rank")).alias("rank_sum"),
        F.sum("pos").alias("n_pos"),
        F.sum("cnt").alias("n"),
    )
    n_neg = F.col("n") - F.col("n_pos")
    auc = (F.col("rank_sum") - F.col("n_pos") * (F.col("n_pos") + 1) / 2.0) / (F.col("n_pos") * n_neg)
    return agg.select(F.round(auc, 6).alias("auc"), F.col("n_pos").cast("bigint").alias("n_pos"),
                      n_neg.cast("bigint").alias("n_neg"))


def regression_metrics(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    e = F.col(prediction).cast("double") - F.col(label).cast("double")
    return df.agg(
        F.round(F.sqrt(F.avg(e * e)), 6).alias("rmse"),
        F.round(F.avg(F.abs(e)), 6).alias("mae"),
        F.count(F.lit(1)).alias("n"),
    )
