"""O-S1: claim CSV source (header row, every column STRING)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.running import running_total

# Column names of the claim CSV that are not valid identifiers.
RENAMES = {"capital-gains": "capital_gains", "capital-loss": "capital_loss"}


def read_claims(spark: SparkSession, path: str, key: str | None = None) -> DataFrame:
    """Read claim CSV files with every column as STRING (no inference: the
    operators parse what they need, ``?`` and '' mean missing).

    ``case_id`` is the ``key`` column when given, else the row's position in
    the input from 0: files by their paths, in a file line by line, however the
    scan packs files into tasks.  Only the counts of the file blocks (one row
    each) are numbered; the rows themselves are not shuffled.
    """
    df = spark.read.option("header", True).option("inferSchema", False).option("mode", "PERMISSIVE").csv(path)
    for old, new in RENAMES.items():
        if old in df.columns:
            df = df.withColumnRenamed(old, new)
    if key is not None:
        return df.withColumn("case_id", F.col(key))
    local = df.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
                      F.monotonically_increasing_id().alias("_mono"))
    blocks = local.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_mono").alias("_first"))
    upto = running_total(blocks, ["_file", "_block"], value=F.col("_n"), out="_upto")
    starts = upto.select("_file", "_block", (F.col("_upto") - F.col("_n") - F.col("_first")).alias("_shift"))
    return local.join(starts, ["_file", "_block"]).withColumn("case_id", F.col("_shift") + F.col("_mono")).drop(
        "_file", "_block", "_mono", "_shift")


def write_claims(df: DataFrame, path: str) -> None:
    """Write claims back as header CSV (columns as they are, original names)."""
    out = df
    for old, new in RENAMES.items():
        if new in out.columns:
            out = out.withColumnRenamed(new, old)
    out.write.mode("overwrite").option("header", True).csv(path)
