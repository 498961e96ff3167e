"""Entity extraction, dedup and summary cases."""

from pyspark.sql import functions as F

from riskflow.functions.text import entities_to_text
from riskflow.operators import entities as oe


def _extract(spark, text):
    pages = spark.createDataFrame([(1, 0, text)], "doc_id bigint, page_number int, text string")
    return [r.asDict() for r in oe.extract_entities(pages).orderBy("start_char").collect()]


def test_longest_phrase_only(spark):
    ents = _extract(spark, "The policy covers commercial general liability.")
    assert [(e["text"], e["label"]) for e in ents] == [("commercial general liability", "COVERAGE_TYPE")]
    assert ents[0]["start_char"] == 18 and ents[0]["end_char"] == 46


def test_perils_and_whole_tokens(spark):
    ents = _extract(spark, "Previous claims include fire and water damage; fireman saw Fire.")
    assert [(e["text"], e["label"]) for e in ents] == [("fire", "PERIL"), ("water damage", "PERIL")]


def test_money_and_policy(spark):
    ents = _extract(spark, "Premium amount is $50,000. Policy PLY-2024-00892 is active.")
    assert [(e["text"], e["label"]) for e in ents] == [("$50,000", "MONEY"), ("PLY-2024-00892", "POLICY_NUMBER")]
    text = "Premium amount is $50,000. Policy PLY-2024-00892 is active."
    for e in ents:
        assert text[e["start_char"]:e["end_char"]] == e["text"]


def test_offsets_match_python(spark):
    import re

    text = "modified fire-resistive and fire, then fire-resistive steel frame construction, fire"
    ents = _extract(spark, text)
    pat = oe.entity_pattern()
    expected = [(m.group(0), m.start()) for m in re.finditer(pat, text)]
    assert [(e["text"], e["start_char"]) for e in ents] == expected
    assert [e["text"] for e in ents] == ["modified fire-resistive", "fire", "fire-resistive", "steel frame", "fire"]


def test_dedup_keeps_highest_confidence(spark):
    ents = spark.createDataFrame(
        [(1, 0, "fire", "PERIL", 0, 4, 0.85), (1, 0, "Fire", "PERIL", 10, 14, 1.0)],
        "doc_id bigint, page_number int, text string, label string, start_char int, end_char int, confidence double",
    )
    rows = oe.dedup_entities(ents).collect()
    assert len(rows) == 1 and rows[0]["confidence"] == 1.0 and rows[0]["first_start"] == 0


def test_summary_order(spark):
    ents = spark.createDataFrame(
        [(1, 0, "fire", "PERIL", 0, 4, 1.0), (1, 0, "$50,000", "MONEY", 10, 17, 1.0),
         (1, 1, "flood", "PERIL", 0, 5, 1.0), (1, 1, "fire", "PERIL", 9, 13, 1.0)],
        "doc_id bigint, page_number int, text string, label string, start_char int, end_char int, confidence double",
    )
    s = oe.summarize_entities(oe.dedup_entities(ents)).first()
    assert s["entity_summary"] == {"PERIL": ["fire", "flood"], "MONEY": ["$50,000"]}
    assert [e["label"] for e in s["summary_entries"]] == ["PERIL", "MONEY"]


def test_entities_to_text(spark):
    df = spark.createDataFrame([({"PERIL": ["fire", "flood"], "MONEY": ["$5"]},), ({},)],
                               "m map<string,array<string>>")
    got = [r[0] for r in df.select(entities_to_text("m")).collect()]
    assert got == ["money: $5; peril: fire; peril: flood", "empty submission"]


def test_model_hook(spark):
    pages = spark.createDataFrame([(1, 0, "John Smith called")], "doc_id bigint, page_number int, text string")

    def loader():
        return lambda t: [("John Smith", "PERSON", 0, 10)] if "John" in t else []

    rows = oe.extract_with_model(pages, loader).collect()
    assert rows[0]["label"] == "PERSON" and rows[0]["confidence"] == 0.85


def test_explode_with_pos_keeps_order_and_drops_empty(spark):
    from riskflow.functions.core import explode_with_pos

    df = spark.createDataFrame([(1, ["a", "b"]), (2, []), (3, None), (4, ["c"])], "k int, xs array<string>")
    rows = explode_with_pos(df, ["k"], F.col("xs"), "p", "x").orderBy("k", "p").collect()
    assert [(r.k, r.p, r.x) for r in rows] == [(1, 0, "a"), (1, 1, "b"), (4, 0, "c")]
    plan = explode_with_pos(df, ["k"], F.split(F.lit("a b"), " "), "p", "x")._jdf.queryExecution() \
        .optimizedPlan().toString()
    assert "size(" not in plan


def test_dates(spark):
    from riskflow.operators import entities as oe

    text = "Loss on 2024-01-15, reported 3/4/2024 and settled March 5, 2024; ref 12024-01-15, PLY-2024-00012, 1/2/24."
    pages = spark.createDataFrame([(1, 0, text)], "doc_id long, page_number int, text string")
    got = oe.extract_entities(pages).where("label = 'DATE'").orderBy("span_no").collect()
    assert [r["text"] for r in got] == ["2024-01-15", "3/4/2024", "March 5, 2024"]
    assert all(text[r["start_char"]:r["end_char"]] == r["text"] for r in got)


def test_one_walk_equals_the_plain_pattern(spark):
    """Pieces cut in one walk give the matches and offsets of the plain pattern,
    on odd texts and over many matches."""
    import re

    from pyspark.sql import functions as F

    from riskflow.operators import entities as oe

    texts = ["", None, "fire", "afire fire_ Fire fire", "$5,000 and $7 million PLY-2024-00892 XPLY-2024-00892 2024-01-05 January 5, 2024",
             "é fire\u0001flood $1k $2m3", "workers' compensation\ncommercial general liability", "theft " * 500, "1/2/2024 12/31/2023x 31/12/2023"]
    df = spark.createDataFrame([(i, 0, t) for i, t in enumerate(texts)], "doc_id long, page_number int, text string")
    got = [(r.doc_id, r.text, r.start_char, r.end_char) for r in oe.extract_entities(df).collect()]
    plain = re.compile(oe.entity_pattern())
    want = [(i, m.group(), m.start(), m.end()) for i, t in enumerate(texts) for m in plain.finditer(t or "")]
    assert sorted(got) == sorted(want)
    order = [(r.doc_id, r.text) for r in oe.extract_entities(df, offsets=False).orderBy("doc_id", "span_no").collect()]
    assert order == [(i, t) for i, t, *_ in want]
    in_row = oe.page_entities(df, clean=False).orderBy("doc_id").collect()
    assert [[e.text for e in r.entities] for r in in_row] == [[t for j, t, *_ in want if j == i] for i in range(len(texts))]


def _nested_rows(spark):
    rows = [(1, 1, "flood, then Fire alarm; $5K"), (1, 0, "fire and $5k, PLY-2024-00892 fire"), (1, None, "theft on 2024-01-31"),
            (2, 0, None), (3, 0, "nothing"), (None, 0, "fire"), (None, 1, "wind damage $1.50"), (4, 7, "flood"), (4, 6, ""), (4, 5, None)]
    return spark.createDataFrame(rows, "doc_id bigint, page_number int, text string")


def test_nested_dedup_as_in_rows(spark, monkeypatch):
    pages = _nested_rows(spark)
    for offsets in (True, False):
        rows = oe.dedup_entities(oe.extract_entities(pages, offsets=offsets))
        for many in (4096, 1):  # gathered, and by the aggregate for documents of many pages
            monkeypatch.setattr(oe, "MANY_PAGES", many)
            nested = oe.dedup_entities(oe.extract_entities(pages, offsets=offsets, nested=True))
            flat = oe.dedup_rows(nested).select(*rows.columns)
            assert sorted(map(repr, flat.collect())) == sorted(map(repr, rows.collect()))
            got, want = (oe.summarize_entities(d).select("doc_id", "summary_entries").collect() for d in (nested, rows))
            assert sorted(map(repr, got)) == sorted(map(repr, want))


def test_nested_summary_is_one_aggregate_of_pages(spark):
    """No row an entity, no sort by entity texts, no filter that repeats the walk."""
    summary = oe.summarize_entities(oe.dedup_entities(oe.extract_entities(_nested_rows(spark), nested=True)))
    plan = summary._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("Aggregate [") == 1 and plan.count("array_position") == 1


def test_rules_are_tried_where_they_can_begin(spark):
    assert "(?=[A-Z\\$\\dADFJMNOS])" in oe.walk_pattern(oe.vocab.GAZETTEER, oe.DEFAULT_RULES)
    own = [("X", "x+")]
    assert oe.walk_pattern([], own) == "(?:x+)"  # nothing is known of other rules


def test_pages_in_document_order_are_gathered_without_a_sort(spark):
    """An aggregate that collects sorts its rows by document, and spills them, once
    a task has more than a few documents."""
    from riskflow.plans import q_entities

    from .conftest import SF_SMALL

    for query in (q_entities.brief, q_entities.entity_display, q_entities.entity_summary, q_entities.entities_to_text,
                  q_entities.features_submissions):
        plan = query(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "ObjectHashAggregate" not in plan and plan.count("Exchange") == 1 and plan.count("Sort [") == 1
