"""Licence scan: canonical digests of texts, their paragraphs and lines, looked up among those of known licences."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spellings that count as equal, after SPDX's matching guidelines.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "analyse": "analyze",
    "artefact": "artifact",
    "authorisation": "authorization",
    "authorised": "authorized",
    "behaviour": "behavior",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "merchantibility": "merchantability",
    "non commercial": "noncommercial",
    "organisation": "organization",
    "per cent": "percent",
    "programme": "program",
    "recognised": "recognized",
    "sub license": "sublicense",
    "whilst": "while",
}

_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""

#: Texts of public licences and of usual one-line notices.
KNOWN = {
    "MIT": """MIT License
Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "ISC": """ISC License
Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.""",
    "BSD-2-Clause": _BSD_HEAD + _BSD_TAIL,
    "BSD-3-Clause": _BSD_HEAD
    + """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
    + _BSD_TAIL,
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.
Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the product documentation would be appreciated but is not required.
2. Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.
3. This notice may not be removed or altered from any source distribution.""",
    "notice-Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "notice-CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "notice-GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "notice-MIT": "Released under the MIT License.",
}

_COPYRIGHT = r"(^|\n)[^\p{L}\p{N}\n]*(copyright[ \t]*(\(c\)|©|[0-9<\[]|by )|\(c\)[ \t]*[0-9]|©|all rights reserved)[^\n]*"
_PUNCTUATION = r"[^\p{L}\p{N}]+"
#: Between paragraphs; between lines.
_BLANK_LINE, _LINE_END = r"\n[ \t\r]*\n", r"\n"
#: Known units that are broadcast at most, of some 100 bytes each.
MOST_BROADCAST = 10_000


def canonical(text: Column) -> Column:
    """Lower case, without copyright lines, punctuation as single spaces, one spelling of each word."""
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), _COPYRIGHT, "\n"), _PUNCTUATION, " "))
    # two spaces between words and one at each end, so that neighbours don't share one
    same = F.concat(F.lit(" "), F.replace(bare, F.lit(" "), F.lit("  ")), F.lit(" "))
    for word, usual in SPELLINGS.items():
        same = F.replace(same, F.lit(f" {word.replace(' ', '  ')} "), F.lit(f" {usual} "))
    return F.when(bare.rlike(r"\b(" + "|".join(SPELLINGS) + r")\b"), F.trim(F.replace(same, F.lit("  "), F.lit(" ")))).otherwise(bare)


def _digest(text: Column) -> Column:
    """SHA-256 of the canonical text; never null, so that a join asks for it once only."""
    return F.coalesce(F.sha2(canonical(text), 256), F.lit(""))


def known_texts() -> dict[str, str]:
    """KNOWN, and the terms of the longer public licences as Debian's common-licenses has them."""
    return KNOWN | {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in (Path(__file__).parent / "texts").glob("*.txt")}


def _units(text: Column) -> Column:
    """Paragraphs and lines of a text."""
    return F.array_distinct(F.concat(F.split(text, _BLANK_LINE), F.split(text, _LINE_END)))


def known_units(spark: SparkSession, known: dict[str, str]) -> DataFrame:
    """(name, unit, units): digests of the known texts' paragraphs, and how many different ones a text has.

    A title alone in its line, as "MIT License", and whatever has no letter or digit is no unit.
    """
    listed = spark.createDataFrame(sorted(known.items()), "name string, body string")
    parts = listed.select("name", F.explode(F.split("body", _BLANK_LINE)).alias("part")).select("name", canonical(F.col("part")).alias("part"))
    parts = parts.where("part <> ''").select("name", F.sha2("part", 256).alias("unit")).distinct()
    return parts.join(parts.groupBy("name").agg(F.count(F.lit(1)).alias("units")), "name")


def scan_licenses(docs: DataFrame, known: dict[str, str] | None = None, text: str = "text", key: str = "doc_id") -> DataFrame:
    """doc_id, digest, license, licenses of every row of ``docs``.

    digest is the SHA-256 of the canonical text; license names the known licence with that digest, or is
    null; of equal known texts the name that sorts first counts. licenses are the sorted names of all
    known texts that stand in the document: as the whole text, or with each of their paragraphs as a
    paragraph or a line of it, in any order. ``known`` maps names to texts.

    Digests of the whole text and of every paragraph and line are looked up by hash join. The known side
    is as small as that mapping, and broadcast up to MOST_BROADCAST units; of the documents only ids,
    digests and what was found are shuffled.

    Null and empty texts, and texts of punctuation alone, have the digest of the empty string and match
    nothing. Repeated rows come back as often, null ids as null. An empty table gives an empty one. Other
    columns aren't looked at.
    """
    known = known_texts() if known is None else known
    spark = docs.sparkSession
    listed = spark.createDataFrame(sorted(known.items()), "name string, body string").select("name", canonical(F.col("body")).alias("body"))
    whole = listed.where("body <> ''").groupBy(F.sha2("body", 256).alias("whole")).agg(F.min("name").alias("license"), F.collect_set("name").alias("names"))
    units = known_units(spark, known)
    near = F.broadcast if units.count() <= MOST_BROADCAST else (lambda df: df)
    # a row is known by its id and the digest of its exact text; rows that are equal in both find the same
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).select("*", F.sha2("text", 256).alias("raw"))
    said = rows.select("doc_id", "raw", _digest(F.col("text")).alias("digest")).join(near(whole), F.col("digest") == F.col("whole"), "left")
    parts = rows.select("doc_id", "raw", F.explode(_units(F.col("text"))).alias("part"))
    hits = parts.select("doc_id", "raw", _digest(F.col("part")).alias("unit")).join(near(units), "unit")
    full = hits.groupBy("doc_id", "raw", "name", "units").agg(F.count_distinct("unit").alias("n")).where("n = units")
    found = full.groupBy(F.col("doc_id").alias("of"), F.col("raw").alias("of_raw")).agg(F.collect_set("name").alias("found"))
    out = said.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("raw") == F.col("of_raw")), "left")
    nothing = F.array().cast("array<string>")
    both = F.array_union(F.coalesce("names", nothing), F.coalesce("found", nothing))
    return out.select("doc_id", "digest", "license", F.sort_array(both).alias("licenses"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.withColumn("licenses", F.concat_ws(",", "licenses"))


def _sql_text(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def op2_sql() -> str:
    spelled = "' ' || replace(b, ' ', '  ') || ' '"
    for word, usual in SPELLINGS.items():
        spelled = f"replace({spelled}, ' {word.replace(' ', '  ')} ', ' {usual} ')"

    def bare(column: str) -> str:
        return f"trim(regexp_replace(regexp_replace(lower(coalesce({column}, '')), {_sql_text(_COPYRIGHT)}, chr(10), 'g'), {_sql_text(_PUNCTUATION)}, ' ', 'g'))"

    match = _sql_text(r"\b(" + "|".join(SPELLINGS) + r")\b")
    final = f"CASE WHEN regexp_matches(b, {match}) THEN trim(replace({spelled}, '  ', ' ')) ELSE b END"
    values = ", ".join(f"({_sql_text(n)}, {_sql_text(t)})" for n, t in sorted(known_texts().items()))
    paragraphs, lines = (f"string_split_regex({{}}, {_sql_text(x)})" for x in (_BLANK_LINE, _LINE_END))
    return f"""
WITH k0(name, body) AS (VALUES {values}),
kw AS (SELECT name, sha256({final}) AS whole FROM (SELECT name, {bare("body")} AS b FROM k0) WHERE b <> ''),
kp AS (SELECT DISTINCT name, sha256({final}) AS unit FROM (SELECT name, {bare("part")} AS b FROM (SELECT name, unnest({paragraphs.format("body")}) AS part FROM k0)) WHERE b <> ''),
ku AS (SELECT name, unit, count(*) OVER (PARTITION BY name) AS units FROM kp),
d0 AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
d AS (SELECT doc_id, sha256({final}) AS digest FROM (SELECT doc_id, {bare("text")} AS b FROM d0)),
u AS (SELECT doc_id, sha256({final}) AS unit FROM (SELECT doc_id, {bare("part")} AS b FROM (SELECT doc_id, unnest(list_distinct({paragraphs.format("text")} || {lines.format("text")})) AS part FROM d0)) WHERE b <> ''),
f AS (SELECT doc_id, name FROM u JOIN ku USING (unit) GROUP BY doc_id, name, units HAVING count(DISTINCT unit) = units UNION SELECT doc_id, name FROM d JOIN kw ON digest = whole),
a AS (SELECT doc_id, string_agg(name, ',' ORDER BY name) AS licenses FROM f GROUP BY doc_id),
e AS (SELECT doc_id, min(name) AS license FROM d JOIN kw ON digest = whole GROUP BY doc_id)
SELECT d.doc_id, digest, license, coalesce(licenses, '') AS licenses FROM d LEFT JOIN a ON a.doc_id = d.doc_id LEFT JOIN e ON e.doc_id = d.doc_id
"""
