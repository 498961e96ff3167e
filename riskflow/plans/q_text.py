"""Registered queries: text projections and chunking (O-T*, O-S9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as ft
from ..functions.core import WS, explode_with_pos
from ..operators import text as ot
from . import sql_views as sv
from . import views
from .registry import register

C = sv.with_ctes
ARTICLE_START = "<article>"
ARTICLE_ENDS = ["</article>", "<footer"]


@register("clean_text", f"SELECT doc_id, {sv.clean_text('text')} AS clean_text FROM documents")
def clean_text(spark, sf_dir):
    """O-T1 over every document."""
    d = views.table(spark, sf_dir, "documents")
    return d.select("doc_id", ft.clean_text("text").alias("clean_text"))


@register("strip_html", f"SELECT page_id, {sv.html_to_text('html')} AS text FROM pages")
def strip_html(spark, sf_dir):
    """O-T2 over every raw web page."""
    p = views.table(spark, sf_dir, "pages")
    return p.select("page_id", ft.html_to_text("html").alias("text"))


def _section_sql(html: str) -> str:
    starts = sv.match_starts(html, ARTICLE_START)
    start = f"({starts})[-1]"
    ends = [f"list_filter({sv.match_starts(html, e)}, lambda q: q > {start} + 1000)[1]" for e in ARTICLE_ENDS]
    end = f"least(length({html}), {', '.join(ends)})"
    section = sv.html_to_text(f"substring({html}, {start} + 1, {end} - {start})")
    return (f"CASE WHEN len({starts}) > 0 AND length({section}) >= 500 THEN {section} END")


@register("extract_section", f"SELECT page_id, {_section_sql('html')} AS section FROM pages")
def extract_section(spark, sf_dir):
    """O-T3: text from the last ``<article>`` to the first ``</article>`` or
    ``<footer`` more than 1000 chars later; null below 500 chars."""
    p = views.table(spark, sf_dir, "pages")
    return p.select("page_id", ft.extract_section("html", ARTICLE_START, ARTICLE_ENDS, 1000, 500).alias("section"))


@register(
    "paragraphs",
    f"""SELECT doc_id, paragraph_no, paragraph FROM (
  SELECT doc_id, CAST(generate_subscripts(ps, 1) - 1 AS INTEGER) AS paragraph_no, {sv.strip('unnest(ps)')} AS paragraph
  FROM (SELECT doc_id, string_split(text, chr(10)) AS ps FROM documents))
WHERE length(paragraph) >= 200""",
)
def paragraphs(spark, sf_dir):
    """O-T4 with single-newline separators (the documents have no blank lines)."""
    d = views.table(spark, sf_dir, "documents")
    return ot.paragraphs(d, "doc_id", "text", sep="\n", min_len=200)


@register(
    "sentences",
    f"""SELECT doc_id, CAST(generate_subscripts(s, 1) - 1 AS BIGINT) AS sentence_no, unnest(s) AS sentence
FROM (SELECT doc_id, {sv.sentences('text')} AS s FROM documents)""",
)
def sentences(spark, sf_dir):
    """O-T5 over every document."""
    d = views.table(spark, sf_dir, "documents")
    return explode_with_pos(d, ["doc_id"], ft.sentences("text"), "sentence_no", "sentence").withColumn(
        "sentence_no", F.col("sentence_no").cast("bigint")
    )


_PARA_SPLIT_SQL = "string_split_regex(text, " + sv.lit("\n" + WS + "*\n") + ")"

_CHUNK_SQL = f"""paras AS (
  SELECT doc_id, paragraph_no, paragraph FROM (
    SELECT doc_id, generate_subscripts(ps, 1) - 1 AS paragraph_no, {sv.strip('unnest(ps)')} AS paragraph
    FROM (SELECT doc_id, {_PARA_SPLIT_SQL} AS ps FROM documents))
  WHERE length(paragraph) >= 200),
packed AS (
  SELECT doc_id, paragraph_no,
    CASE WHEN length(paragraph) <= 2000 THEN [paragraph] ELSE (
      SELECT CASE WHEN length(acc.cur) >= 200 THEN list_append(acc.chunks, {sv.strip('acc.cur')}) ELSE acc.chunks END
      FROM (SELECT list_reduce({sv.sentences('paragraph')},
        lambda a, s: CASE WHEN length(a.cur) + length(s) > 2000 AND length(a.cur) >= 200
                     THEN {{'chunks': list_append(a.chunks, {sv.strip('a.cur')}), 'cur': s}}
                     ELSE {{'chunks': a.chunks, 'cur': CASE WHEN a.cur <> '' THEN a.cur || ' ' || s ELSE s END}} END,
        {{'chunks': []::VARCHAR[], 'cur': ''}}) AS acc)) END AS chunks
  FROM paras),
pieces AS (
  SELECT doc_id, paragraph_no, generate_subscripts(chunks, 1) AS piece_no, unnest(chunks) AS chunk FROM packed),
chunks AS (
  SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY paragraph_no, piece_no) - 1 AS INTEGER) AS chunk_no,
    chunk FROM pieces)"""


@register("chunk_text", "WITH " + _CHUNK_SQL + "\nSELECT doc_id, chunk_no, chunk FROM chunks")
def chunk_text(spark, sf_dir):
    """O-T6: paragraph/sentence chunking (200..2000 chars) of every document."""
    d = views.table(spark, sf_dir, "documents")
    return ot.chunk_text(d, "doc_id", "text", 200, 2000)


@register(
    "chunk_cases",
    "WITH " + _CHUNK_SQL + """,
docs AS (SELECT doc_id, source AS company FROM documents),
numbered AS (
  SELECT c.doc_id, d.company, c.chunk_no,
    CAST(row_number() OVER (ORDER BY d.company, c.doc_id, c.chunk_no) - 1 AS BIGINT) AS i
  FROM chunks c JOIN docs d USING (doc_id))
SELECT CAST(10000 + i AS BIGINT) AS case_id,
  printf('EDGAR-%s-%04d', replace(upper(company), ' ', '-'), i) AS policy_id,
  '10-K risk disclosure from ' || company AS outcome, 'INFO' AS risk_tier, 0.0::DOUBLE AS claim_amount,
  company, doc_id, chunk_no
FROM numbered""",
)
def chunk_cases(spark, sf_dir):
    """O-T7: chunk case records numbered over (company, document, chunk)."""
    d = views.table(spark, sf_dir, "documents")
    chunks = ot.chunk_text(d, "doc_id", "text", 200, 2000).join(
        d.select("doc_id", F.col("source").alias("company")), "doc_id"
    )
    return ot.chunk_cases(chunks, "company", "doc_id").drop("chunk")


@register(
    "full_text",
    """SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) AS full_text,
  CAST(count(*) AS BIGINT) AS page_count FROM conversations GROUP BY conv_id""",
)
def full_text(spark, sf_dir):
    """O-T15: turns joined by a blank line in turn order, per conversation."""
    c = views.table(spark, sf_dir, "conversations")
    return ot.full_text(c, "conv_id", "turn", "text")


@register(
    "corpus_summary",
    f"""SELECT source, CAST(count(*) AS BIGINT) AS files, CAST(sum(length(text)) AS BIGINT) AS total_chars,
  CAST(sum(len(list_filter(string_split(text, chr(10) || chr(10)), lambda p: length({sv.strip('p')}) > 50))) AS BIGINT) AS paragraphs
FROM documents GROUP BY source""",
)
def corpus_summary(spark, sf_dir):
    """O-S9: files, characters and paragraphs > 50 chars per source."""
    return ot.corpus_summary(views.table(spark, sf_dir, "documents"), "source", "text")


_SECTIONS_SQL = f"""lines AS (
  SELECT submission_id, generate_subscripts(ls, 1) AS line_no, unnest(ls) AS line
  FROM (SELECT submission_id, string_split(narrative, chr(10)) AS ls FROM narratives
        WHERE narrative IS NOT NULL AND narrative <> '')),
marked AS (
  SELECT *, CASE WHEN regexp_matches(line, '^##{WS}+(.+)') THEN regexp_extract(line, '^##{WS}+(.+)', 1)
                 WHEN regexp_matches(line, '^\\*\\*(.+?):\\*\\*{WS}*$') THEN regexp_extract(line, '^\\*\\*(.+?):\\*\\*{WS}*$', 1)
            END AS heading FROM lines),
sec AS (
  SELECT *, sum(CASE WHEN heading IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY submission_id ORDER BY line_no
         ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS section FROM marked),
grp AS (
  SELECT submission_id, section, max(heading) AS heading,
    list(line ORDER BY line_no) FILTER (WHERE heading IS NULL) AS ls FROM sec GROUP BY submission_id, section),
bodies AS (
  SELECT submission_id, section, heading,
    CASE WHEN ls IS NULL OR coalesce(list_position(list_transform(ls, lambda x: x <> ''), true), 0) = 0 THEN ''
         ELSE array_to_string(ls[list_position(list_transform(ls, lambda x: x <> ''), true):], chr(10)) END AS body
  FROM grp)
SELECT CAST(submission_id AS BIGINT) AS submission_id, CAST(section AS BIGINT) AS section, heading, body FROM bodies
WHERE section > 0 OR {sv.strip('body')} <> ''
UNION ALL
SELECT submission_id, 0, NULL, 'No narrative generated.' FROM narratives WHERE narrative IS NULL OR narrative = ''"""


@register("narrative_sections", C(sv.NARRATIVES) + ", " + _SECTIONS_SQL)
def narrative_sections(spark, sf_dir):
    """O-T11: narrative markdown -> ordered (heading, body) sections."""
    out = ot.narrative_sections(views.narratives(spark, sf_dir), "submission_id", "narrative")
    return out.select(
        F.col("submission_id").cast("bigint"), F.col("section").cast("bigint"), "heading", "body"
    )


@register(
    "formats",
    C(sv.SCORED)
    + """SELECT submission_id,
  CASE WHEN round(greatest(raw_amount, 0.0), 0) < 0 THEN '-' ELSE '' END || '$'
    || format('{:,.0f}', abs(round(greatest(raw_amount, 0.0), 0))) AS amount_text,
  printf('%.1f', raw_probability * 100.0) || '%' AS probability_text,
  CASE WHEN raw_amount / 100.0 >= 1000 THEN printf('%.1f', raw_amount / 100.0 / 1000.0) || 's'
       ELSE CAST(CAST(floor(raw_amount / 100.0 + 0.5) AS BIGINT) AS VARCHAR) || 'ms' END AS time_text
FROM scored""",
)
def formats(spark, sf_dir):
    """O-T12: currency, percent and duration display strings."""
    s = views.scored(spark, sf_dir)
    return s.select(
        "submission_id",
        ft.fmt_currency(F.greatest(F.col("raw_amount"), F.lit(0.0))).alias("amount_text"),
        ft.fmt_percent("raw_probability").alias("probability_text"),
        ft.fmt_ms(F.col("raw_amount") / 100.0).alias("time_text"),
    )
