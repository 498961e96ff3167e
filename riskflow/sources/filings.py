"""O-S3 / O-S4: filing text files and filing indexes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_filings(spark: SparkSession, path_glob: str) -> DataFrame:
    """One row per text file ``company_YYYY-MM-DD.txt``: (file_name, company,
    filing_date, text).  Company = name before the last ``_``, ``_`` ->
    space, title case."""
    df = spark.read.text(path_glob, wholetext=True).select(
        F.input_file_name().alias("_path"), F.col("value").alias("text")
    )
    name = F.regexp_extract("_path", r"([^/]+)$", 1)
    stem = F.regexp_replace(name, r"\.txt$", "")
    company_raw = F.regexp_extract(stem, r"^(.*)_[^_]*$", 1)
    company_raw = F.when(company_raw == "", stem).otherwise(company_raw)
    return df.select(
        name.alias("file_name"),
        F.initcap(F.translate(company_raw, "_", " ")).alias("company"),
        F.regexp_extract(stem, r"_([^_]*)$", 1).alias("filing_date"),
        "text",
    )


def latest_filing(index: DataFrame, key: str = "company", form: str = "10-K") -> DataFrame:
    """First listed (= most recent) filing of ``form`` per company from the
    parallel arrays form / accessionNumber / primaryDocument / filingDate."""
    z = F.arrays_zip(
        F.col("form").alias("form"), F.col("accessionNumber").alias("accession"),
        F.col("primaryDocument").alias("document"), F.col("filingDate").alias("filing_date"),
    )
    rows = index.select(key, F.posexplode(z).alias("pos", "f")).where(F.col("f.form") == form)
    return rows.groupBy(key).agg(F.min_by(F.col("f"), F.col("pos")).alias("f")).select(
        key, "f.accession", "f.document", "f.filing_date"
    )


def latest_per_key(df: DataFrame, key: str, order_cols: list[str], where=None) -> DataFrame:
    """The newest row per key (largest ``order_cols``), as one aggregate with
    map-side combine (no per-key list is ever built)."""
    src = df if where is None else df.where(where)
    others = [c for c in src.columns if c != key]
    return src.groupBy(key).agg(
        F.max_by(F.struct(*others), F.struct(*order_cols)).alias("_r")
    ).select(key, *[F.col(f"_r.{c}").alias(c) for c in others])
