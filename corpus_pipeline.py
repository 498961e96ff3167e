"""The training-data pipeline: four stages over ``documents``, each written as
Parquet and read again as the next one's input.

Every stage works on all that its predecessor kept.  All but the last return
the columns of its input unchanged and only drop rows.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import language, packing, quality, simhash
from riskflow.llm.common import staged, table


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents whose quality score is under the threshold."""
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no known language (null, or without a letter)."""
    return language.keep_known(docs)


def simhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near copies the document with the smallest id."""
    return simhash.keep_first(docs)


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The packing of what is left: one row per piece."""
    return packing.pack(docs, packing.word_ids(spark, public_tokenizers.path("word_bpe_49k.json")))


STAGES = [
    ("quality_classifier", quality_classifier),
    ("language_id", language_id),
    ("simhash_dedup", simhash_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: Learned scores and a tokenizer cannot be written in SQL; tests hold the
#: stages against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
