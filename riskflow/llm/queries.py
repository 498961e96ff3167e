"""Registered queries of the operators: each applies its operator, with
production parameters, to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    ball_tree,
    byte_bpe,
    cover_tree,
    hilbert_search,
    importance,
    katz,
    language,
    licenses,
    packing,
    quality,
    simhash,
    token_counts,
    url_reputation,
)
from .common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(fn):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned from the labels that are not held out."""
    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SimHash fingerprint and near-duplicate group of every document."""
    got = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return got.select("doc_id", simhash.hex_print(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op3_url_reputation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every page's url: listed rules, else host reputation."""
    return url_reputation.judge_urls(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"))


ORACLES["op3_url_reputation"] = url_reputation.ORACLE


@query
def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again, as digests."""
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    shared = byte_bpe.encoder(spark, path, public_tokenizers.PATTERN)
    got = table(spark, sf_dir, "documents").select("doc_id", byte_bpe.round_trip(F.col("text"), shared).alias("got"))
    return got.select(
        "doc_id",
        F.size("got.ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("got.ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("got.decoded", 256).alias("decoded_sha256"),
    )


@query
def op5_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and groups of every embedding at cosine 0.98 within its label."""
    return cover_tree.near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLES["op5_cover_tree"] = cover_tree.ORACLE


@query
def op6_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into sequences of at most 4096 tokens."""
    shared = packing.word_ids(spark, public_tokenizers.path("word_bpe_49k.json"))
    return packing.pack(table(spark, sf_dir, "documents"), shared)


@query
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token count of every document."""
    shared = token_counts.counter(spark, public_tokenizers.path("byte_bpe_50k.json"))
    n_tokens = token_counts.count_tokens(F.col("text"), shared)
    return (
        table(spark, sf_dir, "documents")
        .select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), n_tokens.alias("n_tokens"))
        .withColumn("over_limit", F.col("n_tokens") > 512)
    )


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, learned from those not held out."""
    return language.identify(table(spark, sf_dir, "documents"))


@query
def op9_hilbert_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest embeddings of every 20th one, among all."""
    return hilbert_search.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query
def op10_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licences named in every document."""
    return licenses.scan(table(spark, sf_dir, "documents"))


ORACLES["op10_license_scan"] = licenses.ORACLE


@query
def op11_ball_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item."""
    return ball_tree.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


ORACLES["op11_ball_tree"] = ball_tree.ORACLE


@query
def op12_katz_backoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log probability of every document by a backoff model of the others."""
    return katz.score(table(spark, sf_dir, "documents"), katz.held_tenth())


ORACLES["op12_katz_backoff"] = katz.ORACLE


@query
def op13_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents drawn towards the words of the benchmark."""
    got = importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return got.select("doc_id", "n_features", "weight", "score", "rank")


ORACLES["op13_importance_resampling"] = importance.ORACLE


@query
def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four stages of ``corpus_pipeline`` over ``documents``."""
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)
