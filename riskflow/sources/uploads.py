"""O-S2: upload validation over a ``binaryFile`` source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import vocab


def read_uploads(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """Raw files: path, modificationTime, length, content (BINARY)."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(path)


def validate_uploads(files: DataFrame, page_counts: DataFrame | None = None, key: str = "path",
                     max_mb: float = vocab.MAX_UPLOAD_MB, max_pages: int = vocab.MAX_PAGES,
                     magic: bytes = vocab.PDF_MAGIC.encode()) -> DataFrame:
    """Adds ``reject_reason`` (null = accepted) by the first failing rule:
    size above ``max_mb``, wrong leading magic bytes, no pages, too many pages
    (pages from ``page_counts`` (key, page_count), a left join of a
    per-document count), plus ``name_ok`` for a ``.pdf`` file name."""
    size = F.coalesce(F.col("length"), F.length("content")).cast("bigint")
    max_bytes = int(max_mb * 1024 * 1024)
    df = files
    if page_counts is not None:
        df = df.join(page_counts, key, "left")
    else:
        df = df.withColumn("page_count", F.lit(None).cast("bigint"))
    pages = F.col("page_count")
    magic_ok = F.substring(F.col("content"), 1, len(magic)) == F.lit(bytearray(magic))
    reason = (
        F.when(size > max_bytes, F.format_string(f"File exceeds {max_mb:g}MB limit (%.1fMB)", size / 1024.0 / 1024.0))
        .when(~magic_ok, F.lit("File is not a valid PDF (bad magic bytes)"))
        .when(pages.isNotNull() & (pages == 0), F.lit("PDF has no pages"))
        .when(pages.isNotNull() & (pages > max_pages),
              F.format_string(f"PDF has %d pages (limit: {max_pages})", pages))
    )
    return df.withColumn("size_bytes", size).withColumn("reject_reason", reason).withColumn(
        "name_ok", F.lower(F.col(key)).endswith(".pdf") if key in df.columns else F.lit(None)
    )


def split_uploads(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantine) by the validation result."""
    return validated.where(F.col("reject_reason").isNull()), validated.where(F.col("reject_reason").isNotNull())
