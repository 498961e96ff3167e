"""Registered queries: sources and the case index (O-S2, O-S4, O-V6/O-U1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import claims as oc
from ..operators import text as ot
from ..operators import vectors as ov
from ..sources import filings as sf_
from ..sources import uploads as su
from . import sql_views as sv
from . import views
from .q_text import _CHUNK_SQL as CHUNK_SQL
from .registry import register

C = sv.with_ctes
MAGIC = b"<!DOC"


def _page_uploads(spark, sf_dir):
    """Raw pages as uploads with the published limits.  What a real upload can
    be is derived from the page number: every 7th body lost its first letters,
    every 11th has no pages, every 13th has 17 times its ``<p>`` blocks as pages,
    every 17th is 26 MiB longer by its stated length, every 3rd is a .PDF."""
    i = F.col("page_id")
    path = F.concat(F.lit("page-"), i.cast("string"), F.when(i % 3 == 0, F.lit(".PDF")).otherwise(F.lit(".html")))
    blocks = F.size(F.regexp_extract_all("html", F.lit("<p>"), 0)).cast("bigint")
    body = F.when(i % 7 == 0, F.substring("html", 3, 1 << 30)).otherwise(F.col("html"))
    p = views.table(spark, sf_dir, "pages")
    files = p.select(
        path.alias("path"), F.encode(body, "UTF-8").alias("content"),
        (F.octet_length(body) + F.when(i % 17 == 0, 26 * 1024 * 1024).otherwise(0)).cast("bigint").alias("length"), "page_id",
    )
    counts = p.select(
        path.alias("path"), F.when(i % 11 == 0, F.lit(0)).when(i % 13 == 0, blocks * 17).otherwise(blocks).alias("page_count")
    )
    return files, counts


@register(
    "upload_validate",
    """SELECT page_id, size_bytes, page_count,
  CASE WHEN size_bytes > 26214400 THEN printf('File exceeds 25MB limit (%.1fMB)', size_bytes / 1024.0 / 1024.0)
       WHEN substr(body, 1, 5) <> '<!DOC' THEN 'File is not a valid PDF (bad magic bytes)'
       WHEN page_count = 0 THEN 'PDF has no pages'
       WHEN page_count > 200 THEN printf('PDF has %d pages (limit: 200)', page_count) END AS reject_reason,
  page_id % 3 = 0 AS name_ok
FROM (SELECT page_id, body,
        CAST(octet_length(encode(body)) + CASE WHEN page_id % 17 = 0 THEN 27262976 ELSE 0 END AS BIGINT) AS size_bytes,
        CASE WHEN page_id % 11 = 0 THEN 0 WHEN page_id % 13 = 0 THEN blocks * 17 ELSE blocks END AS page_count
      FROM (SELECT page_id, CASE WHEN page_id % 7 = 0 THEN substr(html, 3) ELSE html END AS body,
              CAST(len(regexp_extract_all(html, '<p>', 0)) AS BIGINT) AS blocks FROM pages))""",
)
def upload_validate(spark, sf_dir):
    """O-S2: size / magic / page-count validation of raw pages as uploads."""
    files, counts = _page_uploads(spark, sf_dir)
    v = su.validate_uploads(files, counts, "path", magic=MAGIC)
    return v.select("page_id", "size_bytes", "page_count", "reject_reason", "name_ok")


@register(
    "latest_order",
    """SELECT o_custkey, o_orderkey, o_orderdate_text FROM (
  SELECT o_custkey, o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate_text,
    row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn
  FROM orders WHERE o_orderstatus = 'F') WHERE rn = 1""",
)
def latest_order(spark, sf_dir):
    """O-S4 (aggregate form): the newest order of status F per customer."""
    o = views.table(spark, sf_dir, "orders").select(
        "o_custkey", "o_orderkey", "o_orderdate", "o_orderstatus"
    )
    latest = sf_.latest_per_key(o.where(F.col("o_orderstatus") == "F").drop("o_orderstatus"), "o_custkey",
                                ["o_orderdate", "o_orderkey"])
    return latest.select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate_text"))


def _chunk_cases(spark, sf_dir):
    d = views.table(spark, sf_dir, "documents")
    chunks = ot.chunk_text(d, "doc_id", "text", 200, 2000).join(
        d.select("doc_id", F.col("source").alias("company")), "doc_id"
    )
    # dense 0-based running number over (company, doc, chunk) -> case_id
    return ot.chunk_cases(chunks, "company", "doc_id", offset=0)


@register(
    "case_union",
    C(sv.CLAIMS) + """, claim_ids AS (SELECT case_id FROM claims),
""" + CHUNK_SQL + """,
chunk_ids AS (SELECT row_number() OVER (ORDER BY d.source, c.doc_id, c.chunk_no) - 1 AS i
              FROM chunks c JOIN documents d USING (doc_id)),
u AS (SELECT 'claims' AS source, case_id FROM claim_ids
      UNION ALL SELECT 'filings', (SELECT max(case_id) + 1 FROM claim_ids) + i FROM chunk_ids)
SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(min(case_id) AS BIGINT) AS min_id,
  CAST(max(case_id) AS BIGINT) AS max_id, CAST(count(DISTINCT case_id) AS BIGINT) AS n_distinct
FROM u GROUP BY source""",
)
def case_union(spark, sf_dir):
    """O-V6/O-U1: claim cases followed by filing-chunk cases with ids after them."""
    claims_cases = oc.claim_cases(views.claims(spark, sf_dir)).select("case_id").withColumn("source", F.lit("claims"))
    new = _chunk_cases(spark, sf_dir).select("case_id")
    u = ov.append_cases(claims_cases, new, "case_id", source="filings")
    return u.groupBy("source").agg(
        F.count(F.lit(1)).cast("bigint").alias("n"), F.min("case_id").cast("bigint").alias("min_id"),
        F.max("case_id").cast("bigint").alias("max_id"), F.count_distinct("case_id").cast("bigint").alias("n_distinct"),
    )
