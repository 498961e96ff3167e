"""O-T*: scalar text work as native Column expressions (regexp, split,
higher-order array functions).  No Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import vocab
from .core import WS, col, js_round, strip

# FIXED VALUES: risk-section markers of an annual filing (start, then ends).
FILING_SECTION_START = r"(?i)Item[\s\xa0]*1A[\.\s\xa0—–\-]*Risk\s*Factors"
FILING_SECTION_ENDS = [
    r"(?i)Item[\s\xa0]*1B",
    r"(?i)Item[\s\xa0]*1C",
    r"(?i)Item[\s\xa0]*2[\.\s\xa0—–\-]*(?:Properties|Unresolved)",
]


def clean_text(c: Column | str) -> Column:
    """O-T1: drop NUL, runs of spaces/tabs -> one space, 3+ newlines -> 2, strip."""
    x = F.replace(col(c), F.lit("\u0000"), F.lit(""))
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, r"\n{3,}", "\n\n")
    return strip(x)


def html_to_text(c: Column | str) -> Column:
    """O-T2: tags -> space, then the ordered entity rules, blank collapsing, strip."""
    x = F.regexp_replace(col(c), r"<[^>]+>", " ")
    x = F.regexp_replace(x, r"&nbsp;", " ")
    x = F.regexp_replace(x, r"&amp;", "&")
    x = F.regexp_replace(x, r"&ldquo;|&rdquo;|&#8220;|&#8221;", '"')
    x = F.regexp_replace(x, r"&lsquo;|&rsquo;|&#8216;|&#8217;", "'")
    x = F.regexp_replace(x, r"&mdash;|&#8212;", " -- ")
    x = F.regexp_replace(x, r"&[a-z]+;", " ")
    x = F.regexp_replace(x, r"&#\d+;", " ")
    x = F.regexp_replace(x, r"[ \t]+", " ")
    x = F.regexp_replace(x, rf"\n{WS}*\n+", "\n\n")
    return strip(x)


def match_starts(c: Column | str, pattern: str, matches: Column | None = None) -> Column:
    """0-based start offsets of all non-overlapping matches of ``pattern``.

    ``split`` and ``regexp_extract_all`` walk the same match sequence, so the
    i-th match starts after pieces 0..i and matches 0..i-1: one running sum
    over (piece, match) lengths, linear in the number of matches.  ``pattern``
    must not match the empty string.
    """
    text = col(c)
    pieces = F.split(text, pattern, -1)
    if matches is None:
        matches = F.regexp_extract_all(text, F.lit(pattern), 0)
    plen = F.transform(pieces, lambda p: F.length(p))
    mlen = F.transform(matches, lambda m: F.length(m))
    n = F.size(mlen)
    seg = F.zip_with(F.slice(plen, 1, n), mlen, lambda p, m: p + m)
    before = F.aggregate(
        seg, F.array(F.lit(0)), lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)
    )
    return F.zip_with(F.slice(before, 1, n), F.slice(plen, 1, n), lambda b, p: b + p)


def extract_section(
    c: Column | str,
    start_re: str = FILING_SECTION_START,
    end_res: list[str] | None = None,
    min_gap: int = 1000,
    min_len: int = 500,
) -> Column:
    """O-T3: from the last start match to the earliest end match (over all end
    patterns, each pattern's first match beginning more than ``min_gap`` after
    the start), converted by ``html_to_text``; null without a start or when the
    text is shorter than ``min_len``."""
    html = col(c)
    end_res = FILING_SECTION_ENDS if end_res is None else end_res
    starts = match_starts(html, start_re)
    start = F.element_at(starts, -1)
    ends = [
        F.get(F.filter(match_starts(html, e), lambda p: p > start + min_gap), 0) for e in end_res
    ]
    end = F.least(F.length(html), *ends) if ends else F.length(html)
    section = html_to_text(F.substring(html, start + 1, end - start))
    return F.when(F.size(starts) > 0, F.when(F.length(section) >= min_len, section))


SENTENCE_SPLIT = rf"(?<=[.!?]){WS}+"


def sentences(c: Column | str) -> Column:
    """O-T5: split after ``.``, ``!`` or ``?`` followed by whitespace."""
    return F.split(col(c), SENTENCE_SPLIT, -1)


def entities_to_text(summary: Column | str) -> Column:
    """O-T9: ``label_lower: value`` for labels in name order, ``; ``-joined;
    empty summary -> ``empty submission``."""
    entries = F.array_sort(F.map_entries(col(summary)))
    parts = F.flatten(
        F.transform(
            entries,
            lambda e: F.transform(e["value"], lambda v: F.concat(F.lower(e["key"]), F.lit(": "), v)),
        )
    )
    return F.when(F.size(parts) > 0, F.array_join(parts, "; ")).otherwise(
        F.lit(vocab.EMPTY_SUBMISSION_TEXT)
    )


def brief(ordered_summary: Column | str, text: Column | str, max_len: int = 200) -> Column:
    """O-T8: ``label: v1, v2, v3`` per non-empty label in first-seen order,
    ``; ``-joined, first 200 chars; no labels -> first 200 chars of the text.
    ``ordered_summary`` is ARRAY<STRUCT<label, values>> in first-seen order."""
    s = F.filter(col(ordered_summary), lambda e: F.size(e["values"]) > 0)
    parts = F.transform(
        s, lambda e: F.concat(e["label"], F.lit(": "), F.array_join(F.slice(e["values"], 1, 3), ", "))
    )
    return F.when(F.size(parts) > 0, F.substring(F.array_join(parts, "; "), 1, max_len)).otherwise(
        F.substring(col(text), 1, max_len)
    )


def index_text(entity_text: Column | str, chunk: Column | str, max_len: int = 500) -> Column:
    """O-T10: entity text, or the raw chunk's first 500 chars when nothing was found."""
    et = col(entity_text)
    return F.when(et == vocab.EMPTY_SUBMISSION_TEXT, F.substring(col(chunk), 1, max_len)).otherwise(et)


def fmt_currency(c: Column | str) -> Column:
    """O-T12: ``$1,234`` (US locale, no decimals, halves away from zero)."""
    v = col(c).cast("double")
    whole = F.format_number(F.abs(F.round(v, 0)), 0)
    return F.when(v.isNull(), None).otherwise(
        F.concat(F.when(F.round(v, 0) < 0, F.lit("-")).otherwise(F.lit("")), F.lit("$"), whole)
    )


def fmt_percent(c: Column | str) -> Column:
    """O-T12: ``12.3%`` from a fraction."""
    return F.concat(F.format_string("%.1f", col(c).cast("double") * 100.0), F.lit("%"))


def fmt_ms(c: Column | str) -> Column:
    """O-T12: ``1.2s`` from 1000 ms up, else ``42ms``."""
    ms = col(c).cast("double")
    return F.when(ms >= 1000, F.concat(F.format_string("%.1f", ms / 1000.0), F.lit("s"))).otherwise(
        F.concat(js_round(ms).cast("bigint").cast("string"), F.lit("ms"))
    )


def narrative_context(entities_json: Column, text: Column, prediction_json: Column,
                      neighbours_json: Column, max_text: int = 2000) -> Column:
    """O-T13: the per-submission context handed to a narrative generator."""
    return F.concat(
        F.lit("Entities: "), entities_json, F.lit("\n\nDocument excerpt:\n"),
        F.substring(text, 1, max_text), F.lit("\n\nPrediction: "), prediction_json,
        F.lit("\n\nSimilar cases: "), neighbours_json,
    )
