"""O-S5: persisted case index (records + vectors in one Parquet table)."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession

CASE_SCHEMA = ("case_id bigint, policy_id string, summary string, outcome string, risk_tier string, "
               "claim_amount double, vector array<double>")


def write_cases(cases: DataFrame, path: str, mode: str = "overwrite") -> None:
    cases.write.mode(mode).parquet(path)


def read_cases(spark: SparkSession, path: str) -> DataFrame:
    """The stored cases; a store that does not exist reads as an empty table."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], CASE_SCHEMA)
