"""O-S7 / O-S8: evaluation report and assessment JSON documents."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_report(metrics: DataFrame, cases: DataFrame, path: str, mode: str = "direct",
                 timestamp: str | None = None) -> None:
    """The report as two JSON tables: ``<path>/cases``, one line a case, as many
    files as the cases have partitions; and ``<path>/report``, the one document
    {timestamp, backend_mode, total_cases, metrics}, written last, so a report
    without it was not finished."""
    row = metrics.first().asDict()  # the metrics table is one row
    cases.write.mode("overwrite").option("ignoreNullFields", False).json(f"{path}/cases")
    stamp = F.lit(timestamp) if timestamp else F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ssXXX")
    doc = cases.sparkSession.range(1).select(
        stamp.alias("timestamp"), F.lit(mode).alias("backend_mode"), F.lit(row.get("total_cases")).alias("total_cases"),
        F.struct(*[F.lit(v).alias(k) for k, v in row.items()]).alias("metrics"),
    )
    doc.coalesce(1).write.mode("overwrite").json(f"{path}/report")


def read_report(spark: SparkSession, path: str, case_schema=None) -> tuple[DataFrame, DataFrame]:
    """(metrics one-row table, cases table) of a report: as ``write_report``
    leaves it, or one JSON document that holds its cases (``multiLine``)."""
    try:
        raw = spark.read.json(f"{path}/report")
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        raw = spark.read.option("multiLine", True).json(path)
        return raw.select("total_cases", "metrics.*"), raw.select(F.explode("cases").alias("c")).select("c.*")
    reader = spark.read if case_schema is None else spark.read.schema(case_schema)
    return raw.select("total_cases", "metrics.*"), reader.json(f"{path}/cases")


ANALYSIS_SCHEMA = (
    "submission_id string, filename string, risk_tier string, risk_probability double, "
    "predicted_claim_amount double, "
    "key_risk_factors array<struct<name:string,shap_value:double,direction:string>>, "
    "underwriter_narrative string, "
    "similar_cases array<struct<policy_id:string,similarity_score:double,summary:string,outcome:string>>, "
    "confidence_score double, processing_time_ms double, "
    "hallucination_check struct<detected:boolean,count:int,flags:array<string>,confidence:double>, "
    "entities map<string,array<string>>, "
    "pipeline_trace struct<ingestion_ms:double,prediction_ms:double,rag_ms:double,llm_ms:double>"
)


def read_submissions(spark: SparkSession, path: str) -> DataFrame:
    """Assessment records stored as JSON documents (one per file)."""
    return spark.read.schema(ANALYSIS_SCHEMA).option("multiLine", True).json(path)
