"""Licence scans by canonical digests, in DataFrame operations only.

A text becomes canonical: ASCII letters in lower case, copyright lines dropped, equivalent spellings made one,
everything but letters, digits and characters beyond ASCII turned into single spaces. The digest of the whole
canonical text is joined with the digests of known licences. Notices of one line stand at the end of longer documents,
so each line is a text of its own too: lines as long as some known text are hashed and looked up in the same pass.

Whole texts of the longer licences stand in licence_texts, a file for each; _variants says which variants of them, and of the
short ones, are known. Texts changed in any other way are unknown, and so are whole texts of the CC BY family.

Null and empty texts have no digest and match nothing. A licence given twice under one name counts once; under two
names the first in order is named for whole texts, both for lines. Repeated rows each have a row in the result, which
has its own four columns only: extra columns of the input are not read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Known texts that a scan takes at most: their digests go to every task.
MOST_KNOWN = 10_000

#: Spellings that mean the same, in the order of their replacement.
EQUIVALENT = (("licence", "license"), ("sub-license", "sublicense"), ("non-commercial", "noncommercial"), ("favour", "favor"), ("http:", "https:"), ("©", "(c)"))

#: Known licences, whole short texts and one-line notices, by SPDX identifier.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("MIT", "Released under the MIT License."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, Version 2.0."),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License."),
    ("MIT", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'),
    ("ISC", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
    ("0BSD", 'Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\nTHE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'),
)

#: Titles that stand above texts which have none of their own.
TITLES = {
    "MIT": ("MIT License", "The MIT License", "The MIT License (MIT)", "MIT License (MIT)", "MIT"),
    "ISC": ("ISC License", "The ISC License", "ISC License (ISC)", "ISC"),
    "0BSD": ("BSD Zero Clause License", "Zero-Clause BSD", "BSD 0-Clause License", "0BSD", "BSD Zero Clause License (0BSD)"),
    "BSD-3-Clause": ("BSD 3-Clause License", "The 3-Clause BSD License", "3-Clause BSD License", "The BSD 3-Clause License", "BSD-3-Clause", "New BSD License", "The New BSD License", "BSD License"),
}


def _variants(name: str, text: str) -> set[str]:
    """The text itself, without what follows its terms, without its blank copyright line, and with other item marks, holders and titles."""
    out = {text, re.sub(r"(END OF TERMS AND CONDITIONS).*", r"\1", text, flags=re.S)}
    out |= {re.sub(r"(?m)^[ \t]*Copyright \[yyyy\].*\n", "", x) for x in out}
    if name == "BSD-3-Clause":
        out |= {re.sub(r"(?m)^[1-3]\. ", "* ", x) for x in out}
        out |= {x.replace("the copyright holder nor", f"{holder} nor") for x in out for holder in ("the copyright owner", "the University", "the author", "the organization", "the project")}
        out |= {x.replace("THE COPYRIGHT HOLDER OR", "THE COPYRIGHT OWNER OR") for x in out}
    return out | {f"{title}\n\n{x}" for x in out for title in TITLES.get(name, ())}


def whole_texts() -> tuple[tuple[str, str], ...]:
    """License and text of all variants of whole texts."""
    files = [(p.stem, p.read_text("utf-8")) for p in sorted(Path(__file__).with_name("licence_texts").glob("*.txt"))]
    short = [(name, text) for name, text in KNOWN if name in TITLES and "\n" in text]
    return tuple((name, x) for name, text in [*short, *files] for x in sorted(_variants(name, text)))


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NOTICE = r"(^|\n)[^a-z0-9\n(]*(copyright[ \t:,]*(\(c\)|[0-9]{4}|by )|\(c\)[ \t]*[0-9]|all rights reserved)[^\n]*"
_OTHER = r"[^a-z0-9\n\x{80}-\x{10FFFF}]+"


def canonical_lines(text: Column) -> Column:
    """The canonical lines that aren't empty."""
    out = F.translate(text, _UPPER, _LOWER)
    for other, one in EQUIVALENT:
        out = F.replace(out, F.lit(other), F.lit(one))
    out = F.regexp_replace(F.regexp_replace(out, _NOTICE, "$1"), _OTHER, " ")
    return F.filter(F.transform(F.split(out, "\n"), lambda x: F.trim(x)), lambda x: x != "")


def canonical(text: Column) -> Column:
    return F.array_join(canonical_lines(text), " ")


def known(spark: SparkSession, licences: tuple[tuple[str, str], ...] | None = None) -> DataFrame:
    """license and text of KNOWN and the whole texts, or of other licences."""
    return spark.createDataFrame(list(KNOWN + whole_texts() if licences is None else licences), "license string, text string")


def scan(docs: DataFrame, licences: DataFrame) -> DataFrame:
    """doc_id, digest, license (of the whole text) and notices (names found in its lines, in order) for each row of docs(doc_id, text)."""
    forms = licences.select("license", canonical("text").alias("form")).filter("form <> ''").select("license", F.md5("form").alias("digest"), F.length("form").alias("size"))
    names = forms.groupBy("digest", "size").agg(F.min("license").alias("license"), F.array_sort(F.collect_set("license")).alias("all"))
    known = names.limit(MOST_KNOWN + 1).collect()  # bounded, and checked
    if len(known) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    lines = docs.select("doc_id", canonical_lines(F.col("text")).alias("lines")).select("doc_id", F.array_join("lines", " ").alias("form"), _notices(F.col("lines"), known).alias("notices"))
    whole = lines.select("doc_id", F.when(F.col("form") != "", F.md5("form")).alias("digest"), F.coalesce("notices", F.lit("")).alias("notices"))
    return whole.join(F.broadcast(names.select("digest", "license")), "digest", "left").select("doc_id", "digest", "license", "notices")


def _notices(lines: Column, known: list) -> Column:
    """The names of the lines that are known texts, in order, joined by commas.

    Few lines are as long as a known text, so few are hashed.
    """
    if not known:
        return F.lit("")
    sizes = sorted({r["size"] for r in known})
    table = F.create_map(*(x for r in sorted(known, key=lambda r: r["digest"]) for x in (F.lit(r["digest"]), F.array(*map(F.lit, r["all"])))))
    fit = F.filter(lines, lambda x: F.length(x).isin(sizes))
    found = F.flatten(F.filter(F.transform(fit, lambda x: F.try_element_at(table, F.md5(x))), lambda x: x.isNotNull()))
    return F.array_join(F.array_sort(F.array_distinct(found)), ",")


def _literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _sql_lines(text: str) -> str:
    out = f"translate({text}, '{_UPPER}', '{_LOWER}')"
    for other, one in EQUIVALENT:
        out = f"replace({out}, {_literal(other)}, {_literal(one)})"
    out = f"regexp_replace(regexp_replace({out}, {_literal(_NOTICE)}, '\\1', 'g'), {_literal(_OTHER)}, ' ', 'g')"
    return f"list_filter(list_transform(string_split({out}, chr(10)), lambda x: trim(x)), lambda x: x <> '')"


SCAN_SQL = f"""
with k as (select license, array_to_string({_sql_lines("text")}, ' ') as form from (values {", ".join(f"({_literal(a)}, {_literal(b)})" for a, b in KNOWN)}) v(license, text)),
n as (select distinct license, md5(form) as digest from k where form <> ''),
d as (select doc_id, {_sql_lines("text")} as lines from documents),
w as (select doc_id, lines, case when len(lines) > 0 then md5(array_to_string(lines, ' ')) end as digest from d),
f as (select doc_id, string_agg(distinct license, ',' order by license) as notices from (select doc_id, md5(unnest(lines)) as digest from d) join n using (digest) group by doc_id)
select w.doc_id, w.digest, (select min(license) from n where n.digest = w.digest) as license, coalesce(f.notices, '') as notices
from w left join f on w.doc_id = f.doc_id
"""
