"""O-M8..O-M13: attributions and their ranking.

The values of a key are one array in its row, in feature order: contributions,
ranking and the top-5 list are expressions of that row.  Attributions that come
in long form are gathered into that array once per key.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.core import explode_with_pos, pick


@dataclass(frozen=True)
class LinearModel:
    """Terms of a fitted linear model: coefficient and training mean of each
    feature, and the margin at the means.  They belong to the model, so a row
    scores the same whatever rows are scored beside it."""

    coefficients: Mapping[str, float]
    means: Mapping[str, float]
    intercept: float = 0.0

    def contributions(self, feature_names: list[str] = vocab.FEATURE_NAMES) -> Column:
        """ARRAY<DOUBLE> of beta_j * (x_j - mean_j), from the feature columns."""
        return F.array(*[
            F.lit(float(self.coefficients.get(n, 0.0))) * (F.col(n).cast("double") - F.lit(float(self.means[n])))
            for n in feature_names
        ])

    def margin(self, contributions: Column) -> Column:
        return F.lit(float(self.intercept)) + F.aggregate(contributions, F.lit(0.0), lambda a, v: a + v)


def explain_linear(features_df: DataFrame, key: str, model: LinearModel,
                   feature_names: list[str] = vocab.FEATURE_NAMES) -> DataFrame:
    """O-M8: exact additive contributions of a linear model, long form
    (key, feature_index, feature, shap_value): one generator projection."""
    long = explode_with_pos(features_df, [key], model.contributions(feature_names), "feature_index", "shap_value")
    return long.select(key, F.col("feature_index").cast("int").alias("feature_index"),
                       pick(feature_names, F.col("feature_index")).alias("feature"), "shap_value")


def ranked_factors(values: Column, k: int = vocab.TOP_K_FACTORS, min_abs: float = 1e-6,
                   feature_names: list[str] = vocab.FEATURE_NAMES) -> Column:
    """O-M10 inside the row: of the values of all features, in feature order, the
    k largest |value| (ties: feature order), then those with |v| < 1e-6 dropped,
    as ARRAY<STRUCT<feature_index, name, shap_value, direction>>.  No explode, no
    sort across rows, no shuffle."""
    entries = F.transform(values, lambda v, i: F.struct((-F.abs(v)).alias("a"), i.alias("i"), v.alias("v")))
    top = F.filter(F.slice(F.array_sort(entries), 1, k), lambda e: e["a"] <= -min_abs)
    names = F.array(*[F.lit(vocab.FEATURE_DISPLAY_NAMES.get(n, n)) for n in feature_names])
    return F.transform(top, lambda e: F.struct(
        e["i"].cast("int").alias("feature_index"),
        F.get(names, e["i"]).alias("name"),
        F.round(e["v"], 6).alias("shap_value"),
        F.when(e["v"] > 0, F.lit("increases_risk")).otherwise(F.lit("decreases_risk")).alias("direction"),
    ))


def factor_list(ranked: Column) -> Column:
    """``ranked_factors`` as ARRAY<STRUCT<name, shap_value, direction>>."""
    return F.transform(ranked, lambda f: F.struct(f["name"].alias("name"), f["shap_value"].alias("shap_value"),
                                                  f["direction"].alias("direction")))


def top_factors(df: DataFrame, key: str, values: str = "shap_values", k: int = vocab.TOP_K_FACTORS) -> DataFrame:
    """O-M10, one row per listed factor: (key, factor_pos, feature_index, name,
    shap_value, direction), from one array of values per key."""
    rows = explode_with_pos(df, [key], ranked_factors(F.col(values), k), "factor_pos", "f")
    return rows.select(key, F.col("factor_pos").cast("int").alias("factor_pos"), "f.*")


def collect_values(long_df: DataFrame, key: str, value: str = "shap_value",
                   n: int = len(vocab.FEATURE_NAMES)) -> DataFrame:
    """Attributions -> (key, shap_values ARRAY<DOUBLE> in feature order): long ones
    are gathered by key, nested ones are in their row already."""
    if "shap_values" in long_df.columns:
        return long_df.select(key, "shap_values")
    entries = F.map_from_entries(F.collect_list(F.struct("feature_index", value)))
    return long_df.groupBy(key).agg(entries.alias("_m")).select(
        key, F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.try_element_at(F.col("_m"), i)).alias("shap_values")
    )


def with_distinct(df: DataFrame, cols: list[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """O-M11: run ``fn`` once per distinct value combination of ``cols`` and
    join the result back (null-safe), instead of once per row."""
    distinct = df.select(*cols).distinct()
    out = fn(distinct)
    extra = [c for c in out.columns if c not in cols]
    cond = [df[c].eqNullSafe(out[c]) for c in cols]
    return df.join(out, cond, "left").select(df["*"], *[out[c] for c in extra])


def repeat_ratio(df: DataFrame, cols: list[str]) -> DataFrame:
    """O-M12/O-A7: share of rows whose input was already seen, 1 - distinct/total
    (one aggregate; the distinct count is itself a distributed aggregate)."""
    key = F.struct(*[F.col(c) for c in cols])
    agg = df.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(key).alias("d"))
    return agg.select(
        F.col("n").cast("bigint").alias("n"),
        F.col("d").cast("bigint").alias("n_distinct"),
        F.round(F.when(F.col("n") > 0, 1 - F.col("d") / F.col("n")).otherwise(F.lit(0.0)), 6).alias("repeat_ratio"),
    )


def factor_share(factors: DataFrame, key: str, value: str = "shap_value") -> DataFrame:
    """O-M13: |v| / max |v| * 100 within each key (bar lengths)."""
    w = Window.partitionBy(key)
    mx = F.max(F.abs(F.col(value))).over(w)
    return factors.withColumn("share_pct", F.when(mx > 0, F.abs(F.col(value)) / mx * 100).otherwise(F.lit(0.0)))
