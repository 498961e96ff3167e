"""URL reputation and license scans: SQL twins, planted cases, native plans."""

import contextlib
import io
import re

import duckdb
import pytest

from riskflow.llm import licenses, queries, url_reputation


def twin(sql, **tables):
    con = duckdb.connect()
    for name, df in tables.items():
        con.register(name, df.toPandas())
    rel = con.execute(sql)
    names = [d[0] for d in rel.description]
    return sorted((tuple(r[names.index(c)] for c in sorted(names)) for r in rel.fetchall()), key=str)


def rows(df):
    return sorted((tuple(r[c] for c in sorted(df.columns)) for r in df.collect()), key=str)


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain()
    return out.getvalue()


URLS = [
    None, "", "no scheme.com/en/", "http://a.com", "http://A.COM/x", "https://example.com/en/1", "https://WWW.example.com/en/1?q=/de/",
    "https://m.example.com/en/#x", "https://www.example.com/fr/2", "ftp://x.net/es/", "x.net://y.org/net/es/", "http://net/fr/9",
    "http://notnet/fr/9", "http://b.org/en/17#a", "http://example.com?x=/en/", "http://u:p@h.co.uk:80/a/5", "http://10.0.0.1/7",
    "http://é.org/ä/3?ü", "http://b.org/en/17#a", "http://x.org/a\nb/4", "://", "http:///5",
]


def pages_of(spark, urls):
    return spark.createDataFrame([(i, u, "n") for i, u in enumerate(urls)], "page_id long, url string, host string")


def test_rules_of_the_contract(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = {r.page_id: r for r in url_reputation.judge_urls(pages_of(spark, URLS), labels).collect()}
    assert len(got) == len(URLS)
    want = {0: ("", "", None, "allow"), 3: ("a.com", "", None, "allow"), 4: ("a.com", "/x", "com/", "allow"),
            5: ("example.com", "/en/1", "example.com/en/", "block"), 6: ("www.example.com", "/en/1", "www.example.com/en/", "allow"),
            7: ("m.example.com", "/en/", "example.com/en/", "block"), 8: ("www.example.com", "/fr/2", "com/", "allow"),
            9: ("x.net", "/es/", "net/es/", "block"), 10: ("y.org", "/net/es/", None, "allow"), 11: ("net", "/fr/9", "net/fr/", "block"),
            12: ("notnet", "/fr/9", None, "allow"), 14: ("example.com", "", None, "allow"), 20: ("", "", None, "allow"),
            21: ("", "/5", None, "allow"), 2: ("", "", None, "allow")}
    for i, w in want.items():
        assert (got[i].host, got[i].path, got[i].rule, got[i].verdict) == w, URLS[i]


@pytest.fixture(scope="module")
def planted(spark):
    """bad.org: mostly bad; good.org: mostly good; few.org: one bad page; its
    sibling hosts share farm.org; each page's number is its document."""
    urls, labels, n = [], [], 0
    for host, size, bad in (("bad.org", 60, 50), ("good.org", 80, 4), ("few.org", 1, 1), ("a.farm.org", 40, 36),
                            ("b.farm.org", 30, 27), ("c.farm.org", 0, 0), ("x.co.uk", 12, 2), ("10.0.0.1", 5, 1),
                            *((f"n{i}.org", 20, i % 2) for i in range(40))):
        for i in range(size):
            n += 1
            urls.append(f"http://{host}/p/{n}.html")
            labels.append((n, 0 if i < bad and i % 2 else 1, 1 if i < bad and i % 2 == 0 else 0))
        urls += [f"https://{host}/unlabelled", f"https://{host}/p/99999999999999999999"]
    labels += [(1, 1, 0), (None, 0, 1), (2, None, None), (777_777, 0, 0)]
    return pages_of(spark, urls + URLS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_posterior_bound_and_shrinkage(planted):
    got = {r.host: r for r in url_reputation.judge_urls(*planted).where("rule is null").collect()}
    assert got["bad.org"].verdict == "block" and got["a.farm.org"].verdict == "block" and got["b.farm.org"].verdict == "block"
    assert got["good.org"].verdict == "allow" and got["few.org"].verdict == "allow" and got["10.0.0.1"].verdict == "allow"
    assert (got["bad.org"].host_labelled, got["bad.org"].host_bad) == (60, 50)
    assert got["c.farm.org"].host_labelled == 0


def test_urls_match_sql(planted):
    pages, labels = planted
    want = twin(url_reputation.ORACLE, pages=pages, labels=labels)
    assert rows(url_reputation.judge_urls(pages, labels)) == want
    more = pages.unionByName(pages.limit(40))  # repeated pages count again
    assert rows(url_reputation.judge_urls(more, labels)) == twin(url_reputation.ORACLE, pages=more, labels=labels)


def test_urls_without_rows(spark, planted):
    pages, labels = planted
    assert url_reputation.judge_urls(pages.where("false"), labels).collect() == []
    assert url_reputation.judge_urls(pages, labels.where("false")).where("rule is null and verdict = 'block'").collect() == []


FULL_MIT = "\n".join([
    "MIT License", "", "Copyright (c) 2020 Someone", "", *[s for n, s in licenses.SENTENCES if n.startswith("MIT_GRANT")], "",
    *[s for n, s in licenses.SENTENCES if n in ("MIT_NOTICE", "MIT_AS_IS", "MIT_LIABLE")],
]).replace("copies of the Software, and", "copies of the\n// Software, and")
TEXTS = [
    None, "", " \n ", "Nothing here.", "Released under the MIT License.\nSome text.", "All rights reserved.\nx", "ALL RIGHTS, RESERVED! y",
    "Text before. Licensed under CC BY-NC 4.0.\nMore text", FULL_MIT, "MIT License\n\nbody", "x " * 200_000 + ". Licensed under the Apache License, Version 2.0.",
    "This work is licensed under the GNU General Public License, version 3. Released under the MIT License. Released under the MIT License.",
    "not released under the mit license by us.", "İ released under the MIT License.", "Released under the MIT License",
    "All rights reserved.\n\nAll rights reserved.", "a\x1eall rights reserved\x1eb", "[MIT_REF] <MIT>", "Permission. See the GNU General Public License for more details.",
]


def test_licenses(spark):
    df = spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)], "doc_id long, text string, licenses string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    assert len(got) == len(TEXTS)
    want = {0: ("", 0, "none"), 3: ("", 0, "none"), 4: ("MIT", 1, "allow"), 5: ("Proprietary", 1, "block"), 6: ("Proprietary", 1, "block"),
            7: ("CC-BY-NC-4.0", 1, "block"), 8: ("MIT", 1, "allow"), 9: ("", 0, "unsure"), 10: ("Apache-2.0", 1, "allow"),
            11: ("GPL-3.0,MIT", 3, "block"), 12: ("", 0, "none"), 14: ("MIT", 1, "allow"), 15: ("Proprietary", 2, "block"),
            16: ("Proprietary", 1, "block"), 17: ("", 0, "none"), 18: ("", 0, "unsure")}
    for i, w in want.items():
        assert (got[i].licenses, got[i].n_found, got[i].verdict) == w, TEXTS[i]
    assert got[8].sentence_ids.split(",")[-4:] == ["MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABLE"]
    assert rows(licenses.scan(df)) == twin(licenses.ORACLE, documents=df.select("doc_id", "text"))
    assert licenses.scan(df.where("false")).collect() == []


PLANTED = {
    "Released under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache-2.0",
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "All rights reserved.": "Proprietary",
}
BEFORE = ["| a | b |\n", "word word word word\n", "A table\r\n| 1 | 2 |\r\n", "thonhare.***\n", "No end sign\n=====\n", "x\n  > ", "|\n"]


def plain_ids(text):
    """Known stretches of whole lines in each sentence, the earliest and longest first."""
    low, out = (text or "").translate(str.maketrans(licenses.UPPER, licenses.LOWER)), []
    for sentence in re.split(licenses.BREAK + "|" + licenses.MARK, low):
        lines = [n for n in (re.sub(r"[^a-z0-9]+", " ", x).strip() for x in re.split(r"[\r\n]+", sentence)) if n]
        at = 0
        while at < len(lines):
            ends = [e for e in range(min(len(lines), at + 40), at, -1) if " ".join(lines[at:e]) in licenses.KNOWN]
            out += [licenses.KNOWN[" ".join(lines[at : ends[0]])]] if ends else []
            at = ends[0] if ends else at + 1
    return ",".join(out)


def test_license_lines_after_lines_without_an_end(spark):
    texts = [(b + line + after, name) for line, name in PLANTED.items() for b in BEFORE for after in ("", "\nmore", " More.", "\n| c |")]
    texts += [(b + line[:-1].replace(" ", "\n# ", 3) + "\nnext row", name) for line, name in PLANTED.items() for b in BEFORE]
    texts += [("see\nnot released under the mit license by us", ""), ("a row\n" * 30_000 + "All rights reserved", "Proprietary"),
              ("row\nLicensed under the Apache License, Version 2.0\n(the \"License\");\nyou", "Apache-2.0"),
              ("row\nAll rights reserved\nAll rights\nreserved\nx", "Proprietary")]
    everything = [t for t, _ in texts] + TEXTS
    df = spark.createDataFrame(list(enumerate(everything)), "doc_id long, text string")
    got = {r.doc_id: r for r in licenses.scan(df).collect()}
    for i, (text, name) in enumerate(texts):
        assert got[i].licenses == name, text[-200:]
        assert got[i].verdict == ("block" if name in licenses.BLOCKING else "allow" if name else "none")
    for i, text in enumerate(everything):
        assert got[i].sentence_ids == plain_ids(text), (text or "")[-200:]


def test_rules_name_known_sentences():
    names = [n for n, _ in licenses.SENTENCES]
    assert len(set(names)) == len(names) == len(licenses.KNOWN)
    assert all(i in names for _, _, seq in licenses.RULES for i in seq)
    for a, (_, _, first) in enumerate(licenses.RULES):  # a longer run comes before any run inside it
        for _, _, later in licenses.RULES[a + 1 :]:
            assert not any(later[k : k + len(first)] == first for k in range(len(later)))


@pytest.mark.parametrize("name", ["op3_url_reputation", "op10_license_scan"])
def test_plans_are_native(spark, name):
    text = plan(queries.QUERIES[name](spark, "/root/testdata/sf0.001"))
    assert not any(w in text for w in ("Python", "Pandas", "Arrow", "Cartesian", "NestedLoop"))


def test_page_numbers_are_whole(spark):
    """No prefix of a longer number or of a word counts; a number that fits no
    long is none."""
    from pyspark.sql import functions as F

    from riskflow.llm import url_reputation as u

    paths = {"/12": 12, "/a/12.html": 12, "/12-title": 12, "/12abc": None, "/12abc/7": 7, "/1234567890123456789": 1234567890123456789,
             "/99999999999999999999": None, "/x12": None, "": None}
    rows = spark.createDataFrame([(p,) for p in paths], "path string")
    number = F.regexp_extract("path", u.NUMBER, 1)
    got = {r.path: r.n for r in rows.select("path", F.when(number != "", number).try_cast("long").alias("n")).collect()}
    assert got == paths
