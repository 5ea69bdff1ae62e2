"""License scans: the canonical form of entire texts, looked up by digest among known licences.

A line's canonical form is in lower case, with equivalent spellings made one, and with runs of anything but letters
and digits made one space. A text's is that of its lines that are not empty and no copyright notice, joined by
spaces, without the titles and "all rights reserved" that it begins with; it does not depend on how lines are
wrapped. A digest of it is joined with the digests of the known texts, for every whole document and for every
line as a text of its own, so notices of one line are found within documents.

Only DataFrame functions are used. Equal rows are counted apart; what is shuffled is one row per document.

Edge cases: a null or empty text, or one of punctuation only, matches nothing; an empty table gives no rows; a
known text that is canonically empty is refused; names of further columns cannot clash, as only the id and
the text are read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnlake.llm.common import bounded_broadcast
from tarnlake.llm.license_digests import DIGESTS

# Spellings that count as equal, in the order of their replacement.
SPELLINGS = [
    ("licence", "license"), ("sublicence", "sublicense"), ("acknowledgment", "acknowledgement"), ("analog ", "analogue "),
    ("organisation", "organization"), ("favour", "favor"), ("whilst", "while"), ("wilful", "willful"),
    ("non commercial", "noncommercial"), ("per cent", "percent"), ("copyright owner", "copyright holder"),
]
# Known licences and notices.
KNOWN = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("MIT", "Released under the MIT License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("MIT", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and
associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of
the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO
THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT,
TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""),
    ("ISC", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE
OR PERFORMANCE OF THIS SOFTWARE."""),
    ("0BSD", """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is
hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL,
DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS,
WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE
OR PERFORMANCE OF THIS SOFTWARE."""),
]
# A copyright notice as it is written: the word or sign, and a year, a sign, a place for a year, or a name.
_YEAR = r"(?:(?:19|20)\d\d\b|[<\[{(]\s*(?:year|yyyy|date))"
_OWNER = r"(?-i:(?<=Copyright )(?!Holder|Owner|Licen[sc]e|Notice|Law|Act\b|Rights)\p{Lu}\p{Ll})"
NOTICE = rf"(?i)^[^\p{{L}}\p{{N}}(<\[{{©]*(?:copyright[\s:,]*(?:by\s+)?(?:\(c\)|©|{_YEAR}|{_OWNER})|\(c\)\s*(?:copyright\b|{_YEAR})|©)"
_NAME = "(?:mit|expat|isc|0bsd|unlicense|zlib|(?:new |modified |revised |simplified )?bsd(?: (?:zero|[023]) clause)?|(?:zero|[023]) clause bsd)"
# What a canonical text may begin with besides its terms.
HEAD = rf"^(?:(?:(?:the )?{_NAME} license(?: {_NAME})?|all rights reserved) )+"


def canonical_line(line: Column) -> Column:
    """The canonical form of one line."""
    return _spelled(_plain(line))


def _plain(line: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(line), r"[^\p{L}\p{N}]+", " "))


def _spelled(plain: Column) -> Column:
    return reduce(lambda c, pair: F.replace(c, F.lit(pair[0]), F.lit(pair[1])), SPELLINGS, plain)


def units(text: Column) -> Column:
    """Digests of a text and its lines: the whole text first, null where nothing is left."""
    terms = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: ~x.rlike(NOTICE))
    lines = F.filter(F.transform(terms, _plain), lambda x: x != "")

    def digests(kept: Column) -> Column:
        # Spellings of several words may lie across two lines, so they are made one in the joined text.
        whole = F.regexp_replace(_spelled(F.array_join(kept, " ")), HEAD, "")
        return F.concat(F.array(F.when(whole != "", F.md5(whole))), F.transform(kept, lambda x: F.md5(_spelled(x))))

    return F.transform(F.array(lines), digests)[0]


def known_digests(spark: SparkSession, known: list[tuple[str, str]] = KNOWN) -> DataFrame:
    """``digest`` and ``license`` of the known texts, one row per digest."""
    table = spark.createDataFrame(known, "license string, text string")
    found = table.select("license", units(F.col("text"))[0].alias("digest"))
    return found.where(F.expr("assert_true(digest IS NOT NULL, 'a known text is empty') IS NULL")).groupBy(
        "digest").agg(F.min("license").alias("license"))


def shipped_digests(spark: SparkSession) -> DataFrame:
    """``digest`` and ``license`` of ``KNOWN`` and of the entire texts that are shipped as digests."""
    more = spark.createDataFrame(DIGESTS, "license string, digest string, source string").select("license", "digest")
    return known_digests(spark).select("license", "digest").unionAll(more).groupBy(
        "digest").agg(F.min("license").alias("license"))


def scan(docs: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, the licence that its whole text is, the licences that lines of it are, and their number."""
    known = shipped_digests(docs.sparkSession) if known is None else known
    # Numbered in a step of its own, before a row becomes several.
    numbered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.monotonically_increasing_id().alias("rid"))
    each = numbered.select("doc_id", "rid", F.posexplode(units(F.col("text"))).alias("pos", "digest"))
    # A line that is no known text only carries its row on; rows are combined before the shuffle.
    hits = each.join(bounded_broadcast(known, 100), "digest", "left")
    line = F.when(F.col("pos") > 0, F.col("license"))
    return hits.groupBy("rid", "doc_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("pos") == 0, F.col("license")))).alias("whole"),
        F.sort_array(F.collect_set(line)).alias("lines"), F.count(line).alias("n_lines"),
    ).select("doc_id", F.get("whole", F.lit(0)).alias("license"), F.array_join("lines", ",").alias("line_licenses"),
             F.col("n_lines").alias("n_license_lines"))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs)


def _sql_text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _sql_rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_sql_text, row[:2])) + ")" for row in rows)


# The SQL's regular expressions cannot look around: an owner's name is told in two conditions.
_SQL_START = r"^[^\p{L}\p{N}(<\[{©]*"
_SQL_NOTICE = rf"(?i){_SQL_START}(?:copyright[\s:,]*(?:by\s+)?(?:\(c\)|©|{_YEAR})|\(c\)\s*(?:copyright\b|{_YEAR})|©)"
_SQL_OWNER = rf"{_SQL_START}Copyright \p{{Lu}}\p{{Ll}}"
_SQL_NO_OWNER = rf"(?i){_SQL_START}copyright (?:Holder|Owner|Licen[sc]e|Notice|Law|Act\b|Rights)"


def _sql_spelled(plain: str) -> str:
    return reduce(lambda c, pair: f"replace({c}, '{pair[0]}', '{pair[1]}')", SPELLINGS, plain)


def _sql_units(table: str) -> str:
    """``rid``, the digest of the whole text, and the digests of its lines."""
    return rf"""
  SELECT rid, CASE WHEN whole <> '' THEN md5(whole) END AS whole, list_transform(kept, lambda x: md5({_sql_spelled("x")})) AS lines
  FROM (SELECT rid, kept, regexp_replace({_sql_spelled("array_to_string(kept, ' ')")}, {_sql_text(HEAD)}, '') AS whole
    FROM (SELECT rid, list_filter(list_transform(
        list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: NOT (regexp_matches(x, {_sql_text(_SQL_NOTICE)})
          OR regexp_matches(x, {_sql_text(_SQL_OWNER)}) AND NOT regexp_matches(x, {_sql_text(_SQL_NO_OWNER)}))),
        lambda x: trim(regexp_replace(lower(x), '[^\p{{L}}\p{{N}}]+', ' ', 'g'))), lambda x: x <> '') AS kept FROM {table}))"""


ORACLE = f"""
WITH k0 AS (
  SELECT row_number() OVER () AS rid, * FROM (VALUES {_sql_rows(KNOWN)}) v(license, text)
), d0(license, d) AS (
  VALUES {_sql_rows(DIGESTS)}
), k AS (
  SELECT min(license) AS license, d FROM (
    SELECT license, whole AS d FROM k0 JOIN ({_sql_units("k0")}) USING (rid) UNION ALL SELECT license, d FROM d0) GROUP BY d
), t AS (
  SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), u AS ({_sql_units("t")}
), l AS (
  SELECT rid, string_agg(DISTINCT license, ',' ORDER BY license) AS line_licenses, count(*) AS n
  FROM (SELECT rid, unnest(lines) AS d FROM u) JOIN k USING (d) GROUP BY rid
)
SELECT doc_id, k.license, coalesce(line_licenses, '') AS line_licenses, coalesce(l.n, 0) AS n_license_lines
FROM t JOIN u USING (rid) LEFT JOIN k ON k.d = u.whole LEFT JOIN l USING (rid)
"""
