"""Licence scan by canonical digests.

A text is reduced line by line to lower-case words without copyright lines, punctuation and spelling variants; the digest of what
remains is joined with the digests of known licences. The whole text is one unit, and each line another, for notices.
DataFrame functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duowave.llm.tables import keyed_texts, table, with_text_key
from duowave.plans.scratch import Scratch
from duowave.plans.skew import broadcast_if_small

# Spellings that count as equal, applied to words between single spaces.
SPELLINGS = (
    ("licence", "license"), ("licences", "licenses"), ("licenced", "licensed"), ("sub license", "sublicense"),
    ("sub licence", "sublicense"), ("authorised", "authorized"), ("recognise", "recognize"), ("favour", "favor"),
    ("honour", "honor"), ("whilst", "while"), ("acknowledgement", "acknowledgment"), ("non infringement", "noninfringement"),
    ("copyright holder", "copyright owner"), ("copyright holders", "copyright owners"), ("per cent", "percent"),
    ("v2", "version 2"), ("v3", "version 3"),
)
# How a copyright line starts. A line that goes on with one of these words, or ends, is licence wording wrapped there.
WORDING = (r"(?:notice|holder|owner|licen[cs]e|law|statement|interest|right|term|protection|condition|disclaimer)s?|and|or|in|of|to|"
           r"is|are|as|for|protected|material")
COPYRIGHT = r"^[^a-z0-9]*copyright(?:[^a-z]|$)"
WRAPPED = rf"^[^a-z0-9]*copyright[^a-z0-9©]*(?:$|(?:{WORDING})(?:[^a-z0-9]|$))"
OTHER_NOTICE = r"^[^a-z0-9]*(?:\(c\)|©|all rights reserved)"

_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
    "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
    "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, "
    "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
_ISC_WARRANTY = (
    "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED "
    "WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
    "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
    "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
_BSD_START = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following "
    "conditions are met:\n1. Redistributions of source code must retain the above copyright notice, this list of conditions and the "
    "following disclaimer.\n2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and "
    "the following disclaimer in the documentation and/or other materials provided with the distribution.\n"
)
_BSD_THIRD = (
    "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products "
    "derived from this software without specific prior written permission.\n"
)
_BSD_WARRANTY = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, "
    "BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT "
    "SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL "
    "DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS "
    "INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE "
    "OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
# Fixed values, known texts: published wordings of short licences, and one-line notices.
KNOWN = (
    ("MIT", "MIT License\n" + (_MIT := (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation "
        "files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, "
        "modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software "
        "is furnished to do so, subject to the following conditions:\nThe above copyright notice and this permission notice shall be "
        "included in all copies or substantial portions of the Software.\n" + _WARRANTY))),
    ("MIT", _MIT),
    ("ISC", _ISC := (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies.\n" + _ISC_WARRANTY)),
    ("ISC", "ISC License\n" + _ISC),
    ("0BSD", _ZERO := (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.\n"
        + _ISC_WARRANTY)),
    ("0BSD", "BSD Zero Clause License\n" + _ZERO),
    ("BSD-2-Clause", _BSD_START + _BSD_WARRANTY),
    ("BSD-2-Clause", "BSD 2-Clause License\n" + _BSD_START + _BSD_WARRANTY),
    ("BSD-3-Clause", _BSD_START + _BSD_THIRD + _BSD_WARRANTY),
    ("BSD-3-Clause", "BSD 3-Clause License\n" + _BSD_START + _BSD_THIRD + _BSD_WARRANTY),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "SPDX-License-Identifier: MIT"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "SPDX-License-Identifier: Apache-2.0"),
    ("BSD-3-Clause", "SPDX-License-Identifier: BSD-3-Clause"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
)
# Fixed values, the same texts under other common titles; those of KNOWN stand for texts without a title too.
TITLES = {
    "MIT": ("The MIT License (MIT)", "The MIT License", "MIT License (MIT)", "The MIT License, MIT"),
    "ISC": ("The ISC License", "ISC License (ISC)", "The ISC License (ISC)"),
    "0BSD": ("Zero-Clause BSD", "Zero-Clause BSD License", "Zero-Clause BSD License (0BSD)", "BSD Zero Clause License (0BSD)",
             "The Zero-Clause BSD License", "0BSD License"),
    "BSD-2-Clause": ("The BSD 2-Clause License", "2-Clause BSD License", "The 2-Clause BSD License", "Simplified BSD License",
                     "The Simplified BSD License", "FreeBSD License", "BSD 2-Clause \"Simplified\" License", "BSD-2-Clause"),
    "BSD-3-Clause": ("The BSD 3-Clause License", "3-Clause BSD License", "The 3-Clause BSD License", "New BSD License",
                     "The New BSD License", "Modified BSD License", "BSD 3-Clause \"New\" or \"Revised\" License",
                     "BSD-3-Clause", "BSD License", "The BSD License"),
}
_BODIES = {"MIT": _MIT, "ISC": _ISC, "0BSD": _ZERO, "BSD-2-Clause": _BSD_START + _BSD_WARRANTY,
           "BSD-3-Clause": _BSD_START + _BSD_THIRD + _BSD_WARRANTY}
TITLED = tuple((name, f"{title}\n{_BODIES[name]}") for name, titles in TITLES.items() for title in titles)


def is_notice(line: Column) -> Column:
    """Whether a line in lower case is a copyright line."""
    return line.rlike(OTHER_NOTICE) | (line.rlike(COPYRIGHT) & ~line.rlike(WRAPPED))


def canonical(text: Column) -> Column:
    """Words of a text in lower case, without copyright lines, punctuation and spelling variants; null stays null."""
    out = F.array_join(F.filter(F.split(F.lower(text), "\n"), lambda line: ~is_notice(line)), " ")
    out = F.concat(F.lit(" "), F.regexp_replace(out, "[^a-z0-9]+", " "), F.lit(" "))
    for variant, form in SPELLINGS:
        out = F.replace(out, F.lit(f" {variant} "), F.lit(f" {form} "))
    return F.trim(F.regexp_replace(out, " +", " "))


def line_head(line: Column) -> Column:
    """First word of a line in lower case; empty if there is none or the line is a copyright line."""
    return F.when(is_notice(line), F.lit("")).otherwise(F.regexp_extract(line, "[a-z0-9]+", 0))


def digest(text: Column) -> Column:
    """SHA-256 of the canonical text."""
    return F.sha2(canonical(text), 256)


def known_digests(known: DataFrame) -> DataFrame:
    """``digest``, ``license`` and ``heads`` of a table with ``license`` and ``text``; of one digest the first name by order.

    ``heads`` are the words that a text of this digest can begin with. Texts without words are left out.
    """
    # Written first, as the expressions below would repeat the whole chain of replacements.
    words = Scratch(known.sparkSession, "licenses").write(known.select("license", canonical(F.col("text")).alias("words")), "words")
    first = F.substring_index("words", " ", 1)
    variants = F.array(*[F.when(first == form.split()[0], F.lit(variant.split()[0])) for variant, form in SPELLINGS])
    heads = F.array_distinct(F.array_compact(F.concat(F.array(first), variants)))
    return words.where("words <> ''").select(F.sha2("words", 256).alias("digest"), "license", heads.alias("heads")).groupBy(
        "digest").agg(F.min("license").alias("license"), F.first("heads").alias("heads"))


def scan(df: DataFrame, known: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``license`` (of the whole text, null if unknown) and ``notices`` (sorted licences of its lines) per row.

    ``known`` has ``license`` and ``text``; without it :data:`KNOWN` and :data:`TITLED` are. Null, empty and wordless texts match
    nothing. Repeated rows get equal results. Empty tables give no rows; other columns are not read.

    Only units whose first word begins a known text are reduced and digested. The known digests are broadcast only if
    they are counted to be few; only units that match are grouped.
    """
    spark = df.sparkSession
    known = spark.createDataFrame([*KNOWN, *TITLED], "license string, text string") if known is None else known
    scratch = Scratch(spark, "licenses")
    digests = scratch.write(known_digests(known), "known")
    heads = broadcast_if_small(scratch.write(digests.select(F.explode("heads").alias("head")).distinct(), "heads"))
    docs = with_text_key(keyed_texts(df, id_col, text_col))
    lines = F.transform(F.split("text", "\n"), lambda line: F.struct(line.alias("unit"), line_head(F.lower(line)).alias("head")))
    parts = docs.select("id", "text_key", "text", lines.alias("lines"))
    # A text begins with the first word that any of its lines begins with.
    first = F.try_element_at(F.filter("lines", lambda line: line["head"] != ""), F.lit(1))["head"]
    whole = F.struct(F.col("text").alias("unit"), F.coalesce(first, F.lit("")).alias("head"))
    parts = parts.select("id", "text_key", F.size("lines").alias("n"), F.array_append("lines", whole).alias("units"))
    units = parts.select("id", "text_key", "n", F.posexplode("units").alias("at", "u")).select("id", "text_key", "n", "at", "u.*")
    begun = units.join(heads, "head", "left_semi")
    # Null-safe: a plain join would let Spark test all units' digests for null before the heads are looked at.
    there = broadcast_if_small(digests.withColumnRenamed("digest", "d"))
    hits = begun.withColumn("digest", digest(F.col("unit"))).join(there, F.col("digest").eqNullSafe(F.col("d")))
    line = F.col("at") < F.col("n")
    found = scratch.write(
        hits.groupBy(F.col("id").alias("i"), F.col("text_key").alias("k"))
        .agg(F.max(F.when(~line, F.col("license"))).alias("license"),
             F.array_sort(F.collect_set(F.when(line, F.col("license")))).alias("notices")), "found")
    rows = docs.select("id", "text_key")
    return rows.join(found, rows["id"].eqNullSafe(found["i"]) & (rows["text_key"] == found["k"]), "left").select(
        "id", "license", F.coalesce("notices", F.array().cast("array<string>")).alias("notices"))


def op6(spark, sf_dir: str) -> DataFrame:
    """``op6_license_digests``: licence of each document's whole text and the licences its lines name."""
    return scan(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "license", F.size("notices").cast("long").alias("n_notices"),
        F.array_join("notices", ",").alias("notices"))


def _digest_sql(text: str) -> str:
    kept = (f"NOT (regexp_matches(line, '{OTHER_NOTICE}') OR (regexp_matches(line, '{COPYRIGHT}') AND NOT regexp_matches(line, '{WRAPPED}')))")
    out = f"array_to_string(list_filter(string_split(lower({text}), chr(10)), lambda line: {kept}), ' ')"
    out = f"' ' || regexp_replace({out}, '[^a-z0-9]+', ' ', 'g') || ' '"
    for variant, form in SPELLINGS:
        out = f"replace({out}, ' {variant} ', ' {form} ')"
    return f"trim(regexp_replace({out}, ' +', ' ', 'g'))"


_VALUES = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in (*KNOWN, *TITLED))
OP6_SQL = f"""
WITH known AS (
  SELECT words, min(license) AS license
  FROM (SELECT license, {_digest_sql('text')} AS words FROM (VALUES {_VALUES}) AS k(license, text))
  WHERE words <> '' GROUP BY words),
lines AS (SELECT doc_id, {_digest_sql('unit')} AS words
          FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS unit FROM documents)),
notices AS (SELECT doc_id, list_sort(list(DISTINCT license)) AS found FROM lines JOIN known USING (words) GROUP BY doc_id),
whole AS (SELECT doc_id, {_digest_sql('text')} AS words FROM documents)
SELECT w.doc_id, k.license, CAST(coalesce(len(found), 0) AS BIGINT) AS n_notices,
       coalesce(array_to_string(found, ','), '') AS notices
FROM whole w LEFT JOIN known k ON w.words = k.words LEFT JOIN notices n ON w.doc_id = n.doc_id
"""
