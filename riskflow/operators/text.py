"""O-T4, O-T6, O-T7, O-T11, O-T15: text operators that change row counts.

Long documents are exploded to paragraphs first, so the order-dependent
sentence fold (O-T6) runs per paragraph row and a huge document is spread
over many rows instead of one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.core import WS, explode_with_pos, strip
from ..functions.text import sentences
from .running import running_total

PARAGRAPH_SPLIT = rf"\n{WS}*\n"


def paragraphs(df: DataFrame, key: str, text: str = "text", sep: str = PARAGRAPH_SPLIT,
               min_len: int = 200) -> DataFrame:
    """O-T4: (key, paragraph_no, paragraph): split, strip, keep >= min_len chars."""
    return (
        explode_with_pos(df, [key], F.split(F.col(text), sep, -1), "paragraph_no", "p")
        .select(key, F.col("paragraph_no").cast("int"), strip(F.col("p")).alias("paragraph"))
        .where(F.length("paragraph") >= min_len)
    )


def _pack(sents: Column, min_len: int, max_len: int) -> Column:
    """Greedy sentence packing inside one paragraph (order-dependent fold)."""
    init = F.struct(F.array().cast("array<string>").alias("chunks"), F.lit("").alias("cur"))

    def step(acc, s):
        cur, chunks = acc["cur"], acc["chunks"]
        flush = (F.length(cur) + F.length(s) > max_len) & (F.length(cur) >= min_len)
        return F.when(
            flush, F.struct(F.concat(chunks, F.array(strip(cur))).alias("chunks"), s.alias("cur"))
        ).otherwise(
            F.struct(
                chunks.alias("chunks"),
                F.when(cur != "", F.concat(cur, F.lit(" "), s)).otherwise(s).alias("cur"),
            )
        )

    def finish(acc):
        return F.when(
            F.length(acc["cur"]) >= min_len, F.concat(acc["chunks"], F.array(strip(acc["cur"])))
        ).otherwise(acc["chunks"])

    return F.aggregate(sents, init, step, finish)


def chunk_text(df: DataFrame, key: str, text: str = "text", min_len: int = 200,
               max_len: int = 2000) -> DataFrame:
    """O-T6: (key, chunk_no, chunk).  Paragraphs of at most ``max_len`` chars
    stay whole; longer ones are packed sentence by sentence (a chunk is
    flushed when adding the next sentence would pass ``max_len`` and it
    already has ``min_len`` chars; a short tail is dropped).  The pieces and
    their numbers come from the document's row: nothing is shuffled."""
    paras = F.filter(F.transform(F.split(F.col(text), PARAGRAPH_SPLIT, -1), lambda p: strip(p)),
                     lambda p: F.length(p) >= min_len)
    packed = F.flatten(F.transform(paras, lambda p: F.when(F.length(p) <= max_len, F.array(p)).otherwise(
        _pack(sentences(p), min_len, max_len))))
    return explode_with_pos(df, [key], packed, "chunk_no", "chunk").select(
        key, F.col("chunk_no").cast("int").alias("chunk_no"), "chunk")


def chunk_cases(chunks: DataFrame, company: str = "company", order: str = "doc_id",
                offset: int = vocab.FILING_CASE_ID_OFFSET, bucket_bits: int = 16) -> DataFrame:
    """O-T7: filing chunks -> case records with one running number ``i`` over
    all chunks ordered by (company, order key, chunk_no).

    Chunks are counted per document first, so a document's chunks are one row
    wherever they lie; the counts get a distributed running sum
    (``running_total``), whatever the type of the keys and however they spread;
    ``bucket_bits`` is left for callers of before and has no effect.
    """
    per_doc = chunks.groupBy(company, order).agg(F.count(F.lit(1)).alias("_n"))
    upto = running_total(per_doc, [F.asc(company), F.asc(order)], value=F.col("_n"), out="_upto")
    offsets = upto.select(company, order, (F.col("_upto") - F.col("_n")).alias("_before"))
    i = F.col("_before") + F.col("chunk_no")
    name = F.col(company)
    return chunks.join(offsets, [company, order]).select(
        (F.lit(offset) + i).cast("bigint").alias("case_id"),
        F.format_string("EDGAR-%s-%04d", F.translate(F.upper(name), " ", "-"), i).alias("policy_id"),
        F.concat(F.lit("10-K risk disclosure from "), name).alias("outcome"),
        F.lit("INFO").alias("risk_tier"),
        F.lit(0.0).alias("claim_amount"),
        company,
        order,
        "chunk_no",
        "chunk",
    )


def full_text(pages: DataFrame, key: str = "doc_id", page: str = "page_number",
              text: str = "text") -> DataFrame:
    """O-T15: page texts joined by a blank line in page order, one row per key."""
    return pages.groupBy(key).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col(page).alias("p"), F.col(text).alias("t")))),
                        lambda x: x["t"]),
            "\n\n",
        ).alias("full_text"),
        F.count(F.lit(1)).alias("page_count"),
    )


_HEADING = r"(?U)^##\s+(.+)"
_BOLD_HEADING = r"(?U)^\*\*(.+?):\*\*\s*$"


def narrative_sections(df: DataFrame, key: str, text: str = "narrative") -> DataFrame:
    """O-T11: markdown narrative -> (key, section_no, heading, body).

    Lines are exploded; a running count of heading lines over (key, line_no)
    is the section id; the preamble (section 0 before the first heading)
    comes first when it has non-blank text; no text at all -> one section
    with body ``No narrative generated.``.
    """
    lines = explode_with_pos(df, [key, (F.col(text).isNull() | (F.col(text) == "")).alias("_e")],
                             F.split(F.coalesce(F.col(text), F.lit("")), "\n", -1), "line_no", "line")
    h1 = F.regexp_extract("line", _HEADING, 1)
    h2 = F.regexp_extract("line", _BOLD_HEADING, 1)
    is_h = F.col("line").rlike(_HEADING) | F.col("line").rlike(_BOLD_HEADING)
    lines = lines.withColumn("is_heading", is_h).withColumn(
        "heading", F.when(F.col("line").rlike(_HEADING), h1).when(F.col("line").rlike(_BOLD_HEADING), h2)
    )
    w = Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    lines = lines.withColumn("section", F.sum(F.col("is_heading").cast("int")).over(w))
    sections = lines.groupBy(key, "section").agg(
        F.max("_e").alias("_e"),
        F.max("heading").alias("heading"),
        F.array_sort(F.collect_list(F.when(~F.col("is_heading"), F.struct("line_no", "line")))).alias("_ls"),
    )
    # Leading empty lines of a section never reach its body (the body only
    # starts growing at the first non-empty line).
    ls = F.transform("_ls", lambda x: x["line"])
    first = F.array_position(F.transform(ls, lambda x: x != ""), True)
    body = F.when(first == 0, F.lit("")).otherwise(F.array_join(F.slice(ls, first.cast("int"), F.size(ls)), "\n"))
    sections = sections.select(key, "section", "_e", "heading", body.alias("body"))
    keep = (F.col("section") > 0) | (strip(F.col("body")) != "")
    out = sections.where(keep & ~F.col("_e"))
    empty = df.where(F.col(text).isNull() | (F.col(text) == "")).select(
        key, F.lit(0).alias("section"), F.lit(None).cast("string").alias("heading"),
        F.lit(vocab.EMPTY_NARRATIVE).alias("body"),
    )
    return out.select(key, "section", "heading", "body").unionByName(empty)


def corpus_summary(df: DataFrame, key: str = "source", text: str = "text", min_paragraph: int = 50) -> DataFrame:
    """O-S9: per group: files, total size (chars) and paragraphs longer than 50 chars."""
    paras = F.size(F.filter(F.split(F.col(text), r"\n\n", -1), lambda p: F.length(strip(p)) > min_paragraph))
    return df.groupBy(key).agg(
        F.count(F.lit(1)).alias("files"),
        F.sum(F.length(text)).cast("bigint").alias("total_chars"),
        F.sum(paras).cast("bigint").alias("paragraphs"),
    )
