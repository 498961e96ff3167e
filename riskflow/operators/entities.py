"""O-N1..O-N8: entity extraction, dedup, per-document summary, assembly.

Extraction is a narrow projection: one combined alternation regex (phrases
longest first, then the pattern rules) walked by ``regexp_extract_all`` and
``split`` together to get spans and offsets; the label of a phrase hit comes
from a literal map.  Only dedup and summary shuffle, both by document.  Where
entities stay nested in their pages' rows, one aggregate gathers a document's
pages and the rest happens in its row; as rows, both are aggregates with map-side
combine (a hot document collapses to its distinct entity texts before the
shuffle), which is also the way of documents with very many pages.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import vocab
from ..functions.core import explode_with_pos, map_literal, prefix_sums
from ..functions.text import clean_text
from ..session import staged

_SPECIAL = set(".^$*+?()[]{}|\\-/")


def escape(phrase: str) -> str:
    """Regex-escape a phrase the same way for Java regex and RE2."""
    return "".join("\\" + ch if ch in _SPECIAL else ch for ch in phrase)


MONTHS = ["January", "February", "March", "April", "May", "June", "July", "August", "September", "October",
          "November", "December"]

# (label, regex) pattern rules, in priority order after the phrases.
DEFAULT_RULES = [
    ("POLICY_NUMBER", r"\b" + vocab.POLICY_NUMBER_REGEX + r"\b"),
    ("MONEY", r"\$\d+(?:,\d{3})*(?:\.\d+)?(?: (?:million|billion)|[kKmM]\b)?"),
    ("DATE", r"\b(?:\d{4}-\d{2}-\d{2}|\d{1,2}/\d{1,2}/\d{4}|(?:" + "|".join(MONTHS) + r") \d{1,2}, \d{4})\b"),
]


def trie_regex(phrases: Iterable[str]) -> str:
    """Phrases as one trie-shaped regex: at every node the longer continuation
    is tried before stopping, so at a given start the longest phrase wins
    (same result as a longest-first alternation) while each text position
    costs one character test per trie level instead of one per phrase."""
    trie: dict = {}
    for phrase in phrases:
        node = trie
        for ch in phrase:
            node = node.setdefault(ch, {})
        node[""] = {}

    def build(node: dict) -> str:
        alts = [escape(ch) + build(child) for ch, child in sorted(node.items()) if ch != ""]
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        if "" in node:
            return (body if len(alts) > 1 else "(?:" + body + ")") + "?"
        return body

    return build(trie)


def entity_pattern(gazetteer: Iterable[tuple[str, str]] = vocab.GAZETTEER,
                   rules: Iterable[tuple[str, str]] = DEFAULT_RULES) -> str:
    """One alternation: whole-token phrases (trie, longest first), then the
    rules.  Matches never overlap; at each position the longest phrase wins."""
    phrases = sorted({p for _, p in gazetteer})
    parts = [r"\b" + "(?:" + trie_regex(phrases) + r")\b"] if phrases else []
    parts += [f"(?:{rx})" for _, rx in rules]
    return "|".join(parts)


def _first_characters(phrases: Iterable[str]) -> str:
    return "".join(sorted({escape(p[0]) if p[0] not in "]^" else "\\" + p[0] for p in phrases if p}))


# What a match of a default rule begins with, inside a regex class.
_RULE_STARTS = {DEFAULT_RULES[0][1]: "A-Z", DEFAULT_RULES[1][1]: r"\$", DEFAULT_RULES[2][1]: r"\dADFJMNOS"}


def walk_pattern(gazetteer: Iterable[tuple[str, str]], rules: Iterable[tuple[str, str]]) -> str:
    """``entity_pattern`` for the JVM's matcher: the same matches, but a place
    where no phrase can begin, or none of the rules, is left after one look at
    its character."""
    phrases = sorted({p for _, p in gazetteer})
    parts = [rf"(?=[{_first_characters(phrases)}])\b(?:" + trie_regex(phrases) + r")\b"] if phrases else []
    regexes = [rx for _, rx in rules]
    by_rule = "|".join(f"(?:{rx})" for rx in regexes)
    if regexes and all(rx in _RULE_STARTS for rx in regexes):
        by_rule = f"(?=[{''.join(_RULE_STARTS[rx] for rx in regexes)}])(?:{by_rule})"
    return "|".join(parts + ([by_rule] if regexes else []))


MARK = "\u0001"


def marked_pieces(text: Column, pattern: str) -> Column:
    """A text cut at the matches of ``pattern`` in one walk: what lies between
    at even places, the matches at odd ones.  U+0001 in a text counts as U+FFFD."""
    clear = F.replace(text, F.lit(MARK), F.lit("\ufffd"))
    return F.split(F.regexp_replace(clear, pattern, f"{MARK}$0{MARK}"), MARK, -1)


def _labeller(gazetteer, rules) -> Callable[[Column], Column]:
    """The label of a match: its phrase's, else that of the first rule it fits."""
    labels = map_literal({p: lab for lab, p in gazetteer})

    def label(m: Column) -> Column:
        by_rule = None
        for lab, rx in rules:
            hit = m.rlike("^(?:" + rx + ")$")
            by_rule = F.when(hit, F.lit(lab)) if by_rule is None else by_rule.when(hit, F.lit(lab))
        found = F.try_element_at(labels, m)
        return found if by_rule is None else F.coalesce(found, by_rule)

    return label


def extract_entities(pages: DataFrame, key: str = "doc_id", page: str = "page_number",
                     text: str = "text", gazetteer=vocab.GAZETTEER, rules=DEFAULT_RULES,
                     clean: bool = False, offsets: bool = True, nested: bool = False) -> DataFrame:
    """O-N1/O-N2/O-N3: (key, page_number, span_no, text, label, [start_char,
    end_char,] confidence).

    ``span_no`` is the match's position on its page (the reading order).
    Offsets are per page, 0-based, end exclusive, running sums over the pieces
    of one walk; callers that only need the order of spans (summaries,
    features) pass ``offsets=False``.  Phrase and rule
    hits have confidence 1.0.  ``clean`` applies O-T1 to the page text first.

    ``nested`` leaves the entities in their page's row, in reading order: (key,
    page_number, entities ARRAY<STRUCT<text, label[, start_char]>>), null for a
    null text.  ``dedup_entities`` takes both forms.
    """
    pattern = walk_pattern(gazetteer, rules)
    body = clean_text(F.col(text)) if clean else F.col(text)
    label_of = _labeller(gazetteer, rules)
    if nested and not offsets:
        found = F.transform(F.regexp_extract_all(body, F.lit(pattern), 0),
                            lambda m: F.struct(m.alias("text"), label_of(m).alias("label")))
        return pages.select(key, F.col(page).cast("int").alias("page_number"), found.alias("entities"))
    if offsets:
        cut = pages.select(key, page, marked_pieces(body, pattern).alias("_p"))
        cut = cut.withColumn("_st", prefix_sums(F.transform("_p", lambda p: F.length(p))))
        found = F.filter(F.arrays_zip(F.col("_p").alias("m"), F.col("_st").alias("s")), lambda z, i: i % 2 == 1)
        if nested:
            found = F.transform(found, lambda z: F.struct(
                z["m"].alias("text"), label_of(z["m"]).alias("label"), z["s"].cast("int").alias("start_char")))
            return cut.select(key, F.col(page).cast("int").alias("page_number"), found.alias("entities"))
        hits = explode_with_pos(cut, [key, page], found, "_i", "_z").select(
            key, page, "_i", F.col("_z.m").alias("_m"), F.col("_z.s").alias("_s"))
    else:
        hits = explode_with_pos(pages, [key, page], F.regexp_extract_all(body, F.lit(pattern), 0), "_i", "_m")
    cols = [
        key,
        F.col(page).cast("int").alias("page_number"),
        F.col("_i").cast("int").alias("span_no"),
        F.col("_m").alias("text"),
        label_of(F.col("_m")).alias("label"),
    ]
    if offsets:
        cols += [F.col("_s").cast("int").alias("start_char"),
                 (F.col("_s") + F.length("_m")).cast("int").alias("end_char")]
    return hits.select(*cols, F.lit(1.0).alias("confidence"))


def page_entities(pages: DataFrame, key: str = "doc_id", page: str = "page_number", text: str = "text",
                  gazetteer=vocab.GAZETTEER, rules=DEFAULT_RULES, clean: bool = True, keep: Iterable[str] = ()) -> DataFrame:
    """O-N1/O-N3 in the page's own row: (key, page_number, *keep, entities), the
    entities as ARRAY<STRUCT<text, label, span_no, confidence>> in reading order;
    empty for a page without any (null text included).  Works on streams."""
    pattern = walk_pattern(gazetteer, rules)
    body = clean_text(F.col(text)) if clean else F.col(text)
    label = _labeller(gazetteer, rules)
    hits = F.regexp_extract_all(F.coalesce(body, F.lit("")), F.lit(pattern), 0)
    structs = F.transform(hits, lambda m, i: F.struct(
        m.alias("text"), label(m).alias("label"), i.alias("span_no"), F.lit(1.0).alias("confidence")))
    return pages.select(key, F.col(page).cast("int").alias("page_number"), *keep, structs.alias("entities"))


def extract_with_model(pages: DataFrame, loader: Callable, key: str = "doc_id", page: str = "page_number",
                       text: str = "text", confidence: float = 0.85) -> DataFrame:
    """O-N6: plug-in statistical extractor.  ``loader()`` is called once per
    partition inside the executor and must return ``fn(text) -> [(text,
    label, start, end)]``; spans get ``confidence`` (0.85)."""
    import pandas as pd

    schema = (f"{key} bigint, page_number int, span_no int, text string, label string, start_char int, "
              "end_char int, confidence double")

    def run(batches):
        model = loader()
        for b in batches:
            rows = []
            for k, p, t in zip(b[key], b[page], b[text]):
                spans = sorted(model(t or ""), key=lambda sp: sp[2])
                for i, (et, lab, s, e) in enumerate(spans):
                    rows.append((k, p, i, et, lab, s, e, confidence))
            yield pd.DataFrame(rows, columns=[key, "page_number", "span_no", "text", "label", "start_char",
                                              "end_char", "confidence"])

    return pages.select(key, page, text).mapInPandas(run, schema)


def dedup_entities(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """O-N4: one entity per (key, lower(text), label): the highest confidence,
    ties to the first seen; ``first_page``/``first_span`` (and ``first_start``
    when offsets exist) locate the first occurrence of the key (the output
    order).  One aggregate with map-side combine.

    Nested entities stay nested: (key, entities ARRAY<STRUCT<text, label,
    first_page, first_span[, start_char]>>) in first-seen order, for the keys that
    have any (``dedup_rows`` lays them out as rows)."""
    if "entities" in entities.columns:
        return _dedup_in_documents(entities, key)
    has_offsets = "start_char" in entities.columns
    order = "span_no" if "span_no" in entities.columns else "start_char"
    kept = ["text", "confidence", "page_number"] + (["start_char", "end_char"] if has_offsets else [])
    best = F.min_by(
        F.struct(*kept),
        F.struct((-F.col("confidence")).alias("c"), F.col("page_number"), F.col(order)),
    )
    first_cols = ["page_number", order] + (["start_char"] if has_offsets and order != "start_char" else [])
    first = F.min(F.struct(*first_cols))
    out = [
        key,
        F.col("_b.text").alias("text"),
        "label",
        F.col("_b.confidence").alias("confidence"),
        F.col("_b.page_number").alias("page_number"),
    ]
    if has_offsets:
        out += [F.col("_b.start_char").alias("start_char"), F.col("_b.end_char").alias("end_char")]
    out += [F.col("_f.page_number").alias("first_page"), F.col(f"_f.{order}").alias("first_span")]
    if has_offsets:
        out.append(F.col("_f.start_char").alias("first_start"))
    return (
        entities.groupBy(key, F.lower("text").alias("_lt"), "label")
        .agg(best.alias("_b"), first.alias("_f"))
        .select(*out)
    )


MANY_PAGES = 256  # a document with more is not gathered into one row before its dedup


def _nested_fields(entities: DataFrame) -> list[str]:
    return entities.schema["entities"].dataType.elementType.fieldNames()


def _dedup_in_documents(entities: DataFrame, key: str) -> DataFrame:
    """O-N4 of nested entities, all of one confidence: a document's pages are
    gathered in one row, and its entities kept where (lower(text), label) comes
    first.  Documents of more than MANY_PAGES pages go as rows through the
    aggregate instead, which holds their distinct entities only."""
    counts = entities.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    many = staged(counts.where(F.col("_n") > MANY_PAGES).select(F.col(key).alias("_many")), "many-pages")
    if many.isEmpty():
        return _gathered(entities, key)
    same = F.col(key).eqNullSafe(F.col("_many"))
    rows = dedup_entities(_entity_rows(entities.join(many, same, "left_semi"), key), key)
    keep = ["text", "label", "first_page", "first_span"] + (["first_start"] if "first_start" in rows.columns else [])
    order = F.struct("first_page", "first_span", "label", "text")
    held = rows.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order.alias("o"), F.struct(
        *[F.col(c).alias("start_char" if c == "first_start" else c) for c in keep]).alias("e")))).alias("_e"))
    hot = held.select(key, F.transform("_e", lambda e: e["e"]).alias("entities"))
    return _gathered(entities.join(many, same, "left_anti"), key).unionByName(hot)


def _gathered(entities: DataFrame, key: str) -> DataFrame:
    fields = _nested_fields(entities)
    # A window holds one document's pages at a time, and where the rows come sorted by their document (as
    # the pages' numbering leaves them) neither it nor ``first`` sorts: an aggregate that collects
    # would sort, and spill, every page's entities twice.
    held = F.collect_list(F.struct("page_number", "entities")).over(Window.partitionBy(key))
    one = entities.select(key, held.alias("_h")).groupBy(key).agg(F.first("_h").alias("_h"))
    # asked of the gathered pages: a filter on a later step would repeat that step's work
    any_found = F.exists("_h", lambda p: F.coalesce(F.size(p["entities"]), F.lit(0)) > 0)
    pages = one.where(any_found).select(key, F.sort_array("_h").alias("_p"))
    read = F.filter("_p", lambda p: p["entities"].isNotNull())  # without pages of a null text
    places = F.flatten(F.transform(read, lambda p: F.transform(p["entities"], lambda e, i: F.struct(
        e["text"].alias("text"), e["label"].alias("label"), p["page_number"].alias("first_page"), i.alias("first_span"),
        *[e[f].alias(f) for f in fields[2:]]))))
    seen = pages.select(key, places.alias("_e")).select(key, "_e", F.transform("_e", lambda e: F.concat_ws(
        MARK, F.lower(e["text"]), e["label"])).alias("_k"))
    kept = F.filter("_e", lambda e, i: F.array_position("_k", F.get("_k", i)) == i + 1)
    return seen.select(key, kept.alias("entities"))


def _entity_rows(entities: DataFrame, key: str) -> DataFrame:
    """Nested entities as ``extract_entities`` gives them in rows."""
    at = explode_with_pos(entities, [key, "page_number"], F.col("entities"), "span_no", "_e")
    cols = [key, "page_number", F.col("span_no").cast("int").alias("span_no"), F.col("_e.text").alias("text"),
            F.col("_e.label").alias("label")]
    if "start_char" in _nested_fields(entities):
        cols += [F.col("_e.start_char").alias("start_char"),
                 (F.col("_e.start_char") + F.length("_e.text")).alias("end_char")]
    return at.select(*cols, F.lit(1.0).alias("confidence"))


def dedup_rows(deduped: DataFrame, key: str = "doc_id") -> DataFrame:
    """The nested form of ``dedup_entities`` as rows, with the columns of its
    row form: an entity's first occurrence is the one kept."""
    at = explode_with_pos(deduped, [key], F.col("entities"), "_i", "_e")
    e = lambda name: F.col(f"_e.{name}")
    cols = [key, e("text").alias("text"), e("label").alias("label"), F.lit(1.0).alias("confidence"), e("first_page").alias("page_number")]
    last = [e("first_page").alias("first_page"), e("first_span").alias("first_span")]
    if "start_char" in _nested_fields(deduped):
        cols += [e("start_char").alias("start_char"), (e("start_char") + F.length(e("text"))).alias("end_char")]
        last.append(e("start_char").alias("first_start"))
    return at.select(*cols, *last)


def summarize_entities(deduped: DataFrame, key: str = "doc_id") -> DataFrame:
    """O-N5: (key, entity_summary MAP<label, ARRAY<text>>, summary_entries
    ARRAY<STRUCT<label, values>>), labels and values in first-seen order.

    One aggregate per document over the deduplicated entities (bounded by the
    document's distinct entity texts); labels and their value lists are
    built in the row from the position-sorted entries."""
    if "entities" in deduped.columns:  # nested: gathered already, in first-seen order
        entries = deduped.select(key, F.col("entities").alias("_e"))
    else:
        entries = deduped.groupBy(key).agg(
            F.array_sort(F.collect_list(F.struct("first_page", "first_span", "label", "text"))).alias("_e")
        )
    labels = F.array_distinct(F.transform("_e", lambda e: e["label"]))
    ordered = F.transform(
        labels,
        lambda lab: F.struct(
            lab.alias("label"),
            F.transform(F.filter("_e", lambda e: e["label"] == lab), lambda e: e["text"]).alias("values"),
        ),
    )
    staged = entries.select(key, ordered.alias("summary_entries"))
    return staged.select(
        key,
        F.map_from_entries(F.transform("summary_entries", lambda e: F.struct(e["label"], e["values"]))).alias(
            "entity_summary"
        ),
        "summary_entries",
    )


def summarize_long(deduped: DataFrame, key: str = "doc_id") -> DataFrame:
    """O-N5 long form: (key, label, label_pos, value_pos, value), the truth
    behind the summary map."""
    s = summarize_entities(deduped, key)
    labels = explode_with_pos(s, [key], F.col("summary_entries"), "label_pos", "e").select(
        key, F.col("e.label").alias("label"), F.col("label_pos").cast("bigint").alias("label_pos"), "e"
    )
    return explode_with_pos(labels, [key, "label", "label_pos"], F.col("e.values"), "value_pos", "value") \
        .withColumn("value_pos", F.col("value_pos").cast("bigint"))


def summarize_without_dedup(entities: DataFrame, key: str = "doc_id") -> DataFrame:
    """O-N5 as the filing job uses it: distinct exact texts per label, first
    seen order, without the confidence dedup step."""
    order = "span_no" if "span_no" in entities.columns else "start_char"
    firsts = entities.groupBy(key, "label", "text").agg(
        F.min(F.struct("page_number", order)).alias("_f")
    ).select(key, "label", "text", F.col("_f.page_number").alias("first_page"),
             F.col(f"_f.{order}").alias("first_span"))
    return summarize_entities(firsts, key)


def assemble_documents(files: DataFrame, pages: DataFrame, key: str = "doc_id") -> DataFrame:
    """O-N7: one row per document: page_count, full_text, entity summary.
    Documents without pages keep 0 / '' / empty map."""
    from .text import full_text

    ft = full_text(pages, key)
    summ = summarize_entities(dedup_entities(extract_entities(pages, key, offsets=False, nested=True), key), key)
    return (
        files.join(ft, key, "left")
        .join(summ, key, "left")
        .select(
            "*",
        )
        .withColumn("page_count", F.coalesce(F.col("page_count"), F.lit(0)).cast("bigint"))
        .withColumn("full_text", F.coalesce(F.col("full_text"), F.lit("")))
        .withColumn(
            "entity_summary",
            F.coalesce(F.col("entity_summary"), F.create_map().cast("map<string,array<string>>")),
        )
    )


def entity_display(summary_entries_col: str = "summary_entries") -> "F.Column":
    """O-N8: labels with values as ``label: v1, v2`` lines (empty labels dropped)."""
    s = F.filter(F.col(summary_entries_col), lambda e: F.size(e["values"]) > 0)
    return F.transform(s, lambda e: F.concat(e["label"], F.lit(": "), F.array_join(e["values"], ", ")))
