"""License scans by sentence rules.

A text is cut into sentences, each normalised to lower-case words.  In a
sentence, every stretch from its start or a line start to its end or a line end
is looked up (the earliest first, of these the longest): a known one becomes its
identifier, anything else falls away.  So a known sentence may be wrapped, and a
line of its own is not glued to a line before it that has no end sign.  Ordered
rules then rewrite runs of identifiers into licence names, longest runs first,
so a full licence text counts once and not as its parts; identifiers that no
rule takes remain as an unsure finding.

Only DataFrame functions, in one projection of the scan: no shuffle, nothing
per group, so neither a hot source nor a very long text matters beyond its row.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Sentences end at these signs before white space, and at blank lines.
BREAK = r"[.!?;:]+[ \t\r\n\f]+|\n[ \t\r]*\n"
MARK = "\x1e"
#: Between two words of a sentence: a space, or a line end.
GAP = "[ \n]"

#: Known licence sentences and their identifiers.
SENTENCES = [
    ("ALL_RIGHTS", "All rights reserved."),
    ("APACHE2_REF", "Licensed under the Apache License, Version 2.0."),
    ("APACHE2_THE", 'Licensed under the Apache License, Version 2.0 (the "License");'),
    ("APACHE2_COMPLY", "you may not use this file except in compliance with the License."),
    ("APACHE2_OBTAIN", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"),
    ("AS_IS_UNLESS", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.'),
    ("APACHE2_SEE", "See the License for the specific language governing permissions and limitations under the License."),
    ("MIT_REF", "Released under the MIT License."),
    ("MIT_UNDER", "Licensed under the MIT License."),
    ("MIT_THIS", "This project is licensed under the MIT License."),
    ("MIT_TITLE", "The MIT License"),
    ("MIT_TITLE_2", "MIT License"),
    ("MIT_GRANT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'),
    ("MIT_NOTICE", "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("MIT_AS_IS", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.'),
    ("MIT_LIABLE", "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("GPL3_WORK", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL_FREE", "This program is free software:"),
    ("GPL3_REDIST", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL2_REDIST", "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 2 of the License, or (at your option) any later version."),
    ("GPL_HOPE", "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;"),
    ("GPL_NO_WARRANTY", "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("GPL_SEE", "See the GNU General Public License for more details."),
    ("CC_BY_NC4", "Licensed under CC BY-NC 4.0."),
    ("CC_BY_NC4_WORK", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC_BY4", "Licensed under CC BY 4.0."),
    ("CC_BY4_WORK", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC_BY_SA4_WORK", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("BSD_REDIST", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("BSD_SOURCE", "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."),
    ("BSD_BINARY", "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("BSD_NAMES", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."),
]

#: Ordered rules: licence, what it allows, runs of sentence identifiers.
RULES = [
    ("MIT", "allow", ["MIT_GRANT", "MIT_NOTICE", "MIT_AS_IS", "MIT_LIABLE"]),
    ("MIT", "allow", ["MIT_GRANT", "MIT_NOTICE"]),
    ("Apache-2.0", "allow", ["APACHE2_THE", "APACHE2_COMPLY", "APACHE2_OBTAIN", "AS_IS_UNLESS", "APACHE2_SEE"]),
    ("Apache-2.0", "allow", ["APACHE2_THE", "APACHE2_COMPLY", "APACHE2_OBTAIN"]),
    ("GPL-3.0-or-later", "block", ["GPL_FREE", "GPL3_REDIST", "GPL_HOPE", "GPL_NO_WARRANTY", "GPL_SEE"]),
    ("GPL-3.0-or-later", "block", ["GPL_FREE", "GPL3_REDIST"]),
    ("GPL-2.0-or-later", "block", ["GPL_FREE", "GPL2_REDIST", "GPL_HOPE", "GPL_NO_WARRANTY", "GPL_SEE"]),
    ("GPL-2.0-or-later", "block", ["GPL_FREE", "GPL2_REDIST"]),
    ("BSD-3-Clause", "allow", ["BSD_REDIST", "BSD_SOURCE", "BSD_BINARY", "BSD_NAMES"]),
    ("BSD-2-Clause", "allow", ["BSD_REDIST", "BSD_SOURCE", "BSD_BINARY"]),
    ("Apache-2.0", "allow", ["APACHE2_REF"]),
    ("Apache-2.0", "allow", ["APACHE2_THE"]),
    ("MIT", "allow", ["MIT_REF"]),
    ("MIT", "allow", ["MIT_UNDER"]),
    ("MIT", "allow", ["MIT_THIS"]),
    ("GPL-3.0", "block", ["GPL3_WORK"]),
    ("CC-BY-NC-4.0", "block", ["CC_BY_NC4"]),
    ("CC-BY-NC-4.0", "block", ["CC_BY_NC4_WORK"]),
    ("CC-BY-SA-4.0", "block", ["CC_BY_SA4_WORK"]),
    ("CC-BY-4.0", "allow", ["CC_BY4"]),
    ("CC-BY-4.0", "allow", ["CC_BY4_WORK"]),
    ("CC0-1.0", "allow", ["CC0"]),
    ("Proprietary", "block", ["ALL_RIGHTS"]),
]


def normalise(sentence: str) -> str:
    """The normal form of one known sentence, as the scan makes it."""
    text = re.sub(BREAK, " ", sentence.translate(str.maketrans(UPPER, LOWER)) + " ")
    return re.sub(r"[^a-z0-9]+", " ", text).strip()


KNOWN = {normalise(s): name for name, s in SENTENCES}
BLOCKING = sorted({name for name, verdict, _ in RULES if verdict == "block"})


#: Known sentences between line or sentence ends, the longest first.  No match
#: goes over a sentence end, and each starts at a line, so the text is passed once.
STRETCH = (f"(?:^|[{MARK}\n]) ?(" + "|".join(s.replace(" ", GAP) for s in sorted(KNOWN, key=len, reverse=True))
           + f")(?= ?(?:[{MARK}\n]|\\z))")


def normal_text(text: Column) -> Column:
    """Lower-case words of a text, with a space, a line end or ``MARK`` (at the
    end of a sentence) between them."""
    low = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    words = F.regexp_replace(F.regexp_replace(low, BREAK, MARK), f"[^a-z0-9{MARK}\r\n]+", " ")
    return F.regexp_replace(words, r" ?[\r\n][ \r\n]*", "\n")


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_sentences, sentence_ids (known ones in
    order, joined by commas; a sentence of several lines can hold several), licenses (each once, in order of its first place),
    n_found, n_unsure (identifiers that no rule took), verdict: block (a licence
    that blocks), allow, unsure (only unsure findings) or none.

    Null, empty and blank texts have no sentence and verdict none.  Texts of any
    length are read whole.  Rows repeat as they come; an empty table is empty."""
    ids = F.create_map(*[F.lit(x) for pair in KNOWN.items() for x in pair])
    cut = docs.select(F.col(doc_id).alias("doc_id"), normal_text(F.col(text)).alias("words"))
    stretches = F.regexp_extract_all("words", F.lit(STRETCH), F.lit(1))
    known = cut.select("doc_id", F.regexp_count("words", F.lit(f"[a-z0-9][^{MARK}]*")).cast("long").alias("n_sentences"),
                       F.transform(stretches, lambda s: F.try_element_at(ids, F.translate(s, "\n", " "))).alias("ids"))
    run = F.concat(F.lit(""), F.array_join(F.transform("ids", lambda i: F.concat(F.lit("["), i, F.lit("]"))), ""))
    for name, _, seq in RULES:
        run = F.replace(run, F.lit("".join(f"[{i}]" for i in seq)), F.lit(f"<{name}>"))
    found = known.select("doc_id", "n_sentences", F.array_join("ids", ",").alias("sentence_ids"), run.alias("run"))
    names = found.select(
        "doc_id", "n_sentences", "sentence_ids",
        F.regexp_extract_all("run", F.lit("<([^>]+)>"), F.lit(1)).alias("names"),
        F.size(F.regexp_extract_all("run", F.lit(r"\[([^\]]+)\]"), F.lit(1))).cast("long").alias("n_unsure"),
    )
    blocking = F.array(*[F.lit(b) for b in BLOCKING])
    return names.select(
        "doc_id", "n_sentences", "sentence_ids", F.array_join(F.array_distinct("names"), ",").alias("licenses"),
        F.size("names").cast("long").alias("n_found"), "n_unsure",
        F.when(F.arrays_overlap("names", blocking), "block").when(F.size("names") > 0, "allow")
        .when(F.col("n_unsure") > 0, "unsure").otherwise("none").alias("verdict"),
    )


def _sql_run() -> str:
    run = "array_to_string(list_transform(ids, lambda i: '[' || i || ']'), '')"
    for name, _, seq in RULES:
        run = f"replace({run}, '{''.join(f'[{i}]' for i in seq)}', '<{name}>')"
    return run


def _sql_known() -> str:
    return ", ".join(f"('{s}', '{i}', {len(s.split())})" for s, i in KNOWN.items())


#: The same rows in DuckDB SQL, which finds the stretches by comparing lines:
#: sentences are lists of lines; the lines from one to another, joined, may be
#: known; of these the earliest, and of those the one to the last line.
ORACLE = f"""
WITH RECURSIVE known_sentences(s, id, n_words) AS (VALUES {_sql_known()}),
texts AS (SELECT row_number() OVER () AS row, doc_id, string_split(regexp_replace(regexp_replace(
      translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[.!?;:]+[ \t\r\n\f]+|\n[ \t\r]*\n', chr(30), 'g'),
      '[^a-z0-9\x1e\r\n]+', ' ', 'g'), chr(30)) AS parts FROM documents),
sentences AS (SELECT row, p.at AS sentence, list_filter(list_transform(regexp_split_to_array(p.part, '[\r\n]'), lambda x: trim(x, ' ')), lambda x: x <> '') AS lines
  FROM (SELECT row, unnest(list_transform(range(1, len(parts) + 1), lambda i: {{'at': i, 'part': parts[i]}})) AS p FROM texts)),
held AS (SELECT * FROM sentences WHERE len(lines) > 0),
counts AS (SELECT row, count(*) AS n FROM held GROUP BY row),
starts AS (SELECT row, sentence, i, lines[i] AS line FROM (SELECT row, sentence, lines, unnest(range(1, len(lines) + 1)) AS i FROM held)),
begun AS (SELECT row, sentence, i, s, id, n_words FROM starts JOIN known_sentences ON starts_with(s || ' ', line || ' ')),
stretches AS (SELECT row, sentence, i, id, list_filter(range(i, least(len(lines), i + n_words - 1) + 1),
    lambda j: array_to_string(list_slice(lines, i, j), ' ') = s) AS ends FROM begun JOIN held USING (row, sentence)),
longest AS (SELECT row, sentence, i, max(ends[1]) AS j, arg_max(id, ends[1]) AS id FROM stretches WHERE len(ends) > 0 GROUP BY ALL),
linked AS (SELECT a.row, a.sentence, a.i, a.j, a.id, min(b.i) AS next FROM longest a LEFT JOIN longest b
  ON b.row = a.row AND b.sentence = a.sentence AND b.i > a.j GROUP BY ALL),
taken AS (
  SELECT row, sentence, i, id, next FROM linked WHERE (row, sentence, i) IN (SELECT (row, sentence, min(i)) FROM linked GROUP BY row, sentence)
  UNION ALL
  SELECT l.row, l.sentence, l.i, l.id, l.next FROM taken t JOIN linked l ON l.row = t.row AND l.sentence = t.sentence AND l.i = t.next),
found AS (SELECT row, list(id ORDER BY sentence, i) AS ids FROM taken GROUP BY row),
known AS (SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_sentences, coalesce(ids, []) AS ids
  FROM texts LEFT JOIN counts USING (row) LEFT JOIN found USING (row)),
run AS (SELECT doc_id, n_sentences, array_to_string(ids, ',') AS sentence_ids, {_sql_run()} AS run FROM known),
names AS (SELECT doc_id, n_sentences, coalesce(sentence_ids, '') AS sentence_ids, regexp_extract_all(run, '<([^>]+)>', 1) AS names,
  CAST(len(regexp_extract_all(run, '\\[([^\\]]+)\\]', 1)) AS BIGINT) AS n_unsure FROM run)
SELECT doc_id, n_sentences, sentence_ids,
  coalesce(array_to_string(list_transform(list_filter(range(1, len(names) + 1), lambda i: list_position(names, names[i]) = i),
    lambda i: names[i]), ','), '') AS licenses,
  CAST(len(names) AS BIGINT) AS n_found, n_unsure,
  CASE WHEN len(list_intersect(names, {BLOCKING!r})) > 0 THEN 'block' WHEN len(names) > 0 THEN 'allow'
       WHEN n_unsure > 0 THEN 'unsure' ELSE 'none' END AS verdict
FROM names
"""
