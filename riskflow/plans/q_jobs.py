"""Registered queries for the job compositions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import entities as oe
from . import jobs
from . import sql_views as sv
from . import views
from .q_text import _CHUNK_SQL as CHUNK_SQL
from .registry import register

PATTERN = oe.entity_pattern()


def _label_sql(x: str) -> str:
    from .q_entities import _label_sql as lab

    return lab(x)


FILING_SQL = "WITH " + CHUNK_SQL + f""",
numbered AS (
  SELECT c.doc_id, d.source AS company, c.chunk_no, c.chunk,
    CAST(row_number() OVER (ORDER BY d.source, c.doc_id, c.chunk_no) - 1 AS BIGINT) AS i
  FROM chunks c JOIN documents d USING (doc_id)),
hits AS (
  SELECT i, CAST(generate_subscripts(m, 1) AS BIGINT) AS span, unnest(m) AS text FROM (
    SELECT i, regexp_extract_all(chunk, {sv.lit(PATTERN)}, 0) AS m FROM numbered)),
firsts AS (
  SELECT i, {_label_sql('text')} AS label, text, min(span) AS span FROM hits GROUP BY ALL),
labs AS (SELECT i, label, min(span) AS lspan FROM firsts GROUP BY ALL),
vals AS (
  SELECT f.i, f.label, l.lspan, f.text, row_number() OVER (PARTITION BY f.i, f.label ORDER BY f.span) AS vpos
  FROM firsts f JOIN labs l USING (i, label)),
per_label AS (
  SELECT i, label, lspan, string_agg(text, ', ' ORDER BY vpos) FILTER (WHERE vpos <= 3) AS first3,
    list(text ORDER BY vpos) AS all_vals FROM vals GROUP BY ALL),
per_case AS (
  SELECT i, string_agg(label || ': ' || first3, '; ' ORDER BY lspan) AS brief_text,
    string_agg(array_to_string(list_transform(all_vals, lambda v: lower(label) || ': ' || v), '; '), '; '
               ORDER BY label) AS entity_text
  FROM per_label GROUP BY i)
SELECT CAST(10000 + n.i AS BIGINT) AS case_id, printf('EDGAR-%s-%04d', replace(upper(n.company), ' ', '-'), n.i) AS policy_id,
  coalesce(substring(p.brief_text, 1, 200), substring(n.chunk, 1, 200)) AS summary,
  '10-K risk disclosure from ' || n.company AS outcome, 'INFO' AS risk_tier, 0.0::DOUBLE AS claim_amount,
  n.company, n.doc_id, n.chunk_no,
  coalesce(p.entity_text, substring(n.chunk, 1, 500)) AS index_text
FROM numbered n LEFT JOIN per_case p USING (i)"""


@register("filing_index", FILING_SQL)
def filing_index(spark, sf_dir):
    """O-T6 -> O-T7 -> entities per chunk -> O-T8 / O-T9 / O-T10: case records
    and the text to embed for every chunk of every document (documents stand
    in for filings, source for the company)."""
    d = views.table(spark, sf_dir, "documents").select("doc_id", "text", F.col("source").alias("company"))
    return jobs.filing_cases(d)
