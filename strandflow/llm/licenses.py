"""Licence scans by canonical digest lookup, in DataFrame functions only.

Canonical form: A-Z are lower-cased; runs of ASCII characters other than letters and digits become one
space; equivalent spellings become one; line breaks count as spaces. Copyright statements and titles stand
at the top of a licence: a text also counts without its top lines (blank, a title, "all rights reserved", or
a statement: a copyright word with a year, or with a mark behind it), with or without the titles, and without
its top paragraphs that begin so, in case a statement goes on over lines. Nothing is taken out below the top in these forms, so they
do not depend on where lines break. The last form is also without all lines below that are statements, or
begin with the mark. Two texts that share one of their forms share its SHA-256 digest, so a whole
text, or a whole line of one, is looked up by an equi-join to the digests of known texts. Known texts are a
table, by default KNOWN and the files of TEXTS (whole licences and standard headers by SPDX identifier);
Spark broadcasts it by itself while its size is under the session's threshold, else it shuffles.

Null and empty texts, and texts of nothing but top lines and no known notice, have an empty form without
them, which matches nothing; an empty table gives an empty one. Repeated documents, also those of equal or
null doc_id, are judged one by one. Of known texts with equal forms, and of several known forms of one
text, the least identifier counts. A very long text is canonicalised whole; its top is at most TOP_LINES
lines. Only doc_id and text are read; other columns, whatever their names, are left out.
"""

from __future__ import annotations

from functools import lru_cache
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Of canonical lines: what a copyright statement begins with, and a whole title. A year may be a placeholder.
STATEMENT = r"(?:(?:copyright|©) ?(?:c |©)|(?:copyright|c|©) ?(?:[12][0-9]{3}|year|yyyy)[^a-z])"
TITLE = r"(?:[^ \n]+ ){0,6}license(?: mit| isc| bsd| [0-9]+| version| v[0-9]+)*"
TOP_LINES = 64
RIGHTS = "all rights reserved"
#: Top lines, of any kind and without titles.
TOP = rf"^(?: ?(?:{STATEMENT}[^\n]*|{TITLE} ?|{RIGHTS} ?)?\n){{1,{TOP_LINES}}}"
TOP_STATEMENTS = rf"^(?: ?(?:{STATEMENT}[^\n]*|{RIGHTS} ?)?\n){{1,{TOP_LINES}}}"
#: The same of paragraphs, which go on over at most 8 lines that are not blank, and end with a blank one.
_ON, _BLANKS = r"[^\n]*(?:\n ?[^ \n][^\n]*){0,7}", rf"(?: ?\n){{0,{TOP_LINES}}}"
PARAGRAPHS = rf"^{_BLANKS}(?: ?(?:{STATEMENT}{_ON}|{TITLE} ?|{RIGHTS} ?)\n ?\n{_BLANKS}){{1,8}}"
PARAGRAPHS_STATEMENTS = rf"^{_BLANKS}(?: ?(?:{STATEMENT}{_ON}|{RIGHTS} ?)\n ?\n{_BLANKS}){{1,8}}"
TOPS = [TOP, TOP_STATEMENTS, PARAGRAPHS, PARAGRAPHS_STATEMENTS]
#: Copyright lines anywhere.
LINES = rf"(^|\n) ?(?:{STATEMENT}|(?:c|©) )[^\n]*"
#: All ASCII characters but letters, digits and line breaks.
PUNCTUATION = r"[\x00-\x09\x0B-\x2F\x3A-\x60\x7B-\x7F]+"
#: Spellings that count as one: pattern, what stands for it ({n} is the n-th group).
SPELLINGS = [
    ("([a-z][a-z])is(e|es|ed|ing|ation|ations)([ \\n]|$)", "{1}iz{2}{3}"),
    ("([a-z][a-z])our(s|ed|ing|able|ite)?([ \\n]|$)", "{1}or{2}{3}"),
    ("(licen|offen|defen|practi)ce", "{1}se"),
    ("dgement", "dgment"),
    ("(cance|labe|mode|signa)ll(ed|ing)", "{1}l{2}"),
    ("(sub|non|per)[ \\n](license|licensed|licensing|commercial|cent)", "{1}{2}"),
    ("copyright[ \\n]owner", "copyright holder"),
    ("https", "http"),
    ("whilst", "while"),
]

_GRANT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files "
    '(the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, '
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so"
)
_AS_IS = (
    'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
    "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY "
    "DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, "
    "ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_TOP = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:\n"
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n"
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the "
    "documentation and/or other materials provided with the distribution.\n"
)
_BSD_NAME = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this "
    "software without specific prior written permission.\n"
)
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED '
    "TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR "
    "CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, "
    "PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF "
    "LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS "
    "SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
#: Public licence texts and notices, by SPDX identifier.
KNOWN = [
    ("MIT", f"MIT License\n\n{_GRANT}, subject to the following conditions:\n\nThe above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\n"
     'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
     "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.\n\n{_AS_IS}"),
    ("0BSD", f"Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n\n{_AS_IS}"),
    ("BSD-2-Clause", _BSD_TOP + _BSD_END),
    ("BSD-3-Clause", _BSD_TOP + _BSD_NAME + _BSD_END),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
]


#: A shipped licence text per file, named by its identifier; `.header` marks a standard header.
TEXTS = Path(__file__).parent / "license_texts"
TERMS_END = "END OF TERMS AND CONDITIONS"


def shipped() -> list[tuple[str, str]]:
    """Identifier and text of each file of TEXTS; what tells how to apply a licence may be left out."""
    out = []
    for file in sorted(TEXTS.glob("*.txt")):
        name, text = file.name.removesuffix(".txt").removesuffix(".header"), file.read_text()
        terms, end, _ = text.partition(TERMS_END)
        out += [(name, x) for x in ([text, terms, terms + end] if end else [text])]
    return out


@lru_cache(maxsize=2)
def _digests(spark: SparkSession) -> list[tuple[str, str]]:
    """The default known texts' digests, made once a session: some dozens of rows."""
    return [tuple(x) for x in known_table(spark, KNOWN + shipped()).select("license_id", "digest").collect()]


def canonical(text: Column) -> Column:
    """The canonical form with line breaks left in; a null text's is null."""
    out = F.regexp_replace(F.translate(text, UPPER, LOWER), PUNCTUATION, " ")
    for pattern, by in SPELLINGS:
        for n in "123":
            by = by.replace("{%s}" % n, f"${n}")
        out = F.regexp_replace(out, pattern, by)
    return out


def forms(canon: Column) -> Column:
    """The different forms of a canonical text: without all its copyright lines, whole, and without each kind of TOPS."""
    cut = F.array_distinct(F.array(canon, *[F.regexp_replace(canon, x, "") for x in TOPS]))  # mostly one
    return F.array_distinct(F.concat(F.array(bare(canon)), F.transform(cut, _flat)))


def _flat(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \n]+", " "))


def bare(canon: Column) -> Column:
    """A canonical text without any copyright line, title at its top or "all rights reserved" there."""
    return _flat(F.regexp_replace(F.regexp_replace(canon, LINES, "$1"), TOP, ""))


def known_table(spark: SparkSession, known: list[tuple[str, str]] | None = None) -> DataFrame:
    """license_id and digest of each form of each known text."""
    made = known is None
    rows = [F.struct(F.lit(i).alias("license_id"), F.lit(t).alias("digest" if made else "text")) for i, t in (_digests(spark) if made else known)]
    texts = spark.range(1).select(F.inline(F.array(*rows)))
    if not made:
        each = F.explode(F.filter(forms(canonical(F.col("text"))), lambda x: x != "")).alias("form")
        texts = texts.select("license_id", each).select("license_id", F.sha2("form", 256).alias("digest"))
    return texts.groupBy("digest").agg(F.min("license_id").alias("license_id"))


def scan(documents: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per document: digest of its bare form, licence of the whole text, licences of whole lines.

    `notices` are the licences of single lines, sorted and comma-joined (empty if none), and
    `n_notices` counts such lines. Every row has a result row, whatever its doc_id.
    """
    known = known if known is not None else known_table(documents.sparkSession)
    # a generator of one row each, as Spark would write what is used several times out several times
    once = lambda c, name: F.explode(F.array(c)).alias(name)
    canon = documents.select(F.monotonically_increasing_id().alias("row"), "doc_id", once(canonical(F.coalesce("text", F.lit(""))), "canon"))
    canon = canon.select("row", "doc_id", "canon", once(forms(F.col("canon")), "forms"))
    units = F.concat(
        F.transform("forms", lambda x, i: F.struct((i + 1).alias("form"), F.sha2(x, 256).alias("digest"))),
        F.transform(F.split("canon", "\n"), lambda x: F.struct(F.lit(0).alias("form"), F.sha2(F.trim(x), 256).alias("digest"))),
    )
    # the bare form, the first, always counts, so that every document has a row
    met = canon.select("row", "doc_id", F.inline(units)).join(known, "digest", "left").where("form = 1 OR license_id IS NOT NULL")
    whole = F.col("form") > 0
    found = met.groupBy("row", "doc_id").agg(
        F.max(F.when(F.col("form") == 1, F.col("digest"))).alias("canonical_sha256"),
        F.min(F.when(whole, F.col("license_id"))).alias("license_id"),
        F.array_sort(F.collect_set(F.when(~whole, F.col("license_id")))).alias("names"),
        F.count(F.when(~whole, F.col("license_id"))).alias("n_notices"),
    )
    return found.select("doc_id", "canonical_sha256", "license_id", F.concat_ws(",", "names").alias("notices"), "n_notices")


def oracle() -> str:
    """The same scan of `documents` in the SQL of the oracle's engine."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"

    def canon(text: str) -> str:
        x = f"regexp_replace(translate({text}, '{UPPER}', '{LOWER}'), {quote(PUNCTUATION)}, ' ', 'g')"
        for pattern, by in SPELLINGS:
            for n in "123":
                by = by.replace("{%s}" % n, f"\\{n}")
            x = f"regexp_replace({x}, {quote(pattern)}, {quote(by)}, 'g')"
        return x

    flat = lambda x: f"trim(regexp_replace({x}, '[ \\n]+', ' ', 'g'))"
    rows = ", ".join(f"({quote(i)}, {' || chr(10) || '.join(quote(x) for x in t.split(chr(10)))})" for i, t in KNOWN)
    lines = f"regexp_replace(regexp_replace(canon, {quote(LINES)}, '\\1', 'g'), {quote(TOP)}, '')"
    cuts = ", ".join(flat(f"regexp_replace(canon, {quote(x)}, '')") for x in TOPS)
    each = lambda column: f"SELECT {column}, {flat(lines)} AS bare, [{flat('canon')}, {cuts}, {flat(lines)}] AS forms FROM"
    return f"""
    WITH k AS ({each("license_id")} (SELECT license_id, {canon("text")} AS canon FROM (VALUES {rows}) v(license_id, text))),
         known AS (SELECT min(license_id) AS license_id, sha256(x) AS digest FROM (SELECT license_id, unnest(forms) AS x FROM k) WHERE x <> '' GROUP BY 2),
         parts AS (SELECT doc_id, {canon("coalesce(text, '')")} AS canon FROM documents),
         d AS ({each("doc_id")} parts),
         notices AS (SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices
                     FROM (SELECT doc_id, sha256(trim(unnest(string_split(canon, chr(10))))) AS digest FROM parts) JOIN known USING (digest) GROUP BY doc_id),
         whole AS (SELECT doc_id, min(license_id) AS license_id FROM (SELECT doc_id, sha256(unnest(forms)) AS digest FROM d) JOIN known USING (digest) GROUP BY doc_id)
    SELECT d.doc_id, sha256(bare) AS canonical_sha256, license_id, coalesce(notices, '') AS notices, CAST(coalesce(n_notices, 0) AS BIGINT) AS n_notices
    FROM d LEFT JOIN whole USING (doc_id) LEFT JOIN notices USING (doc_id)
    """
