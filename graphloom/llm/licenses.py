"""Licence scan by canonical digests, with DataFrame functions only.

A text is normalised (case, equivalent spellings, copyright lines, punctuation, white space) and its MD5 digest joined
to those of known licence texts and notices. The whole text is looked up, and each of its lines as a text of its own,
so that a document holding a notice is found as well as one that is a licence. The known digests are a list given by
the caller, at most ``MOST_KNOWN`` long, and broadcast; digests of lines are counted per document before they are
joined back, and a line that a third of all documents hold costs one digest each, no group of its own.

Defined results: null and blank texts match nothing and have no lines; rows that repeat ``doc_id`` and text are
reported once each with the same finding; of two known texts with one normal form the first name counts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .common import text_key

MOST_KNOWN = 10_000

#: Notices and short licences, as (name, text). Fixed values.
KNOWN = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\");"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation "
            "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
            "permit persons to whom the Software is furnished to do so, subject to the following conditions:\n\nThe above copyright "
            "notice and this permission notice shall be included in all copies or substantial portions of the Software.\n\nTHE "
            "SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE "
            "WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR "
            "COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR "
            "OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies.\n\nTHE SOFTWARE IS "
            "PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES "
            "OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR "
            "CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF "
            "CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("proprietary", "All rights reserved."),
)
#: Spellings taken as one, as (pattern, form); applied to lower-case text in this order. Fixed values.
SPELLINGS = (("licence", "license"), ("favour", "favor"), ("non-infringement", "noninfringement"), ("merchantibility", "merchantability"),
             ("sub-license", "sublicense"), ("per cent", "percent"), ("https:", "http:"))
COPYRIGHT_LINE = "(?m)^[^\\n\\p{L}]*(copyright|\\(c\\)|©)[^\\n]*[0-9]{4}[^\\n]*$"


def normalise(text: Column) -> Column:
    out = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), COPYRIGHT_LINE, "")
    for a, b in SPELLINGS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return F.trim(F.regexp_replace(out, "[^\\p{L}\\p{N}]+", " "))


def scan(docs: DataFrame, known=KNOWN) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, digest, license, n_lines, notices)``, one row per row.

    ``digest`` is that of the whole normalised text, ``license`` its match, ``notices`` the sorted matches of its lines.
    """
    if len(known) > MOST_KNOWN:
        raise ValueError(f"more than {MOST_KNOWN} known texts")
    spark = docs.sparkSession
    listed = spark.createDataFrame([(i, n, t) for i, (n, t) in enumerate(known)], "place int, name string, text string").select(
        "place", "name", F.md5(normalise(F.col("text"))).alias("digest")).groupBy("digest").agg(F.min_by("name", "place").alias("name"))
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    lines = F.filter(F.split(text, "\\n"), lambda s: F.trim(s) != "")
    md5 = lambda s: F.md5(normalise(s))
    rows = docs.select(F.col("doc_id").cast("long"), text_key(text).alias("key"), md5(text).alias("digest"), lines.alias("lines"))
    units = rows.select("doc_id", "key", F.explode(F.concat(
        F.array(F.struct(F.lit(True).alias("whole"), F.col("digest").alias("digest"))),
        F.transform("lines", lambda s: F.struct(F.lit(False).alias("whole"), md5(s).alias("digest"))))).alias("u")).select("doc_id", "key", "u.*")
    told = units.join(F.broadcast(listed), "digest", "left").groupBy("doc_id", "key").agg(
        F.count_if("whole").alias("rows"), F.max(F.when(F.col("whole"), F.col("digest"))).alias("digest"),
        F.max(F.when(F.col("whole"), F.col("name"))).alias("license"), F.count_if(~F.col("whole")).alias("lines"),
        F.array_sort(F.collect_set(F.when(~F.col("whole"), F.col("name")))).alias("notices"))
    return told.select("doc_id", "digest", "license", (F.col("lines") / F.col("rows")).cast("long").alias("n_lines"),
                       F.array_join("notices", ",").alias("notices"), F.explode(F.sequence(F.lit(1), F.col("rows").cast("int"))).alias("row")).drop("row")


def duckdb_sql(known=KNOWN) -> str:
    """The same as SQL."""
    def form(x: str) -> str:
        out = f"regexp_replace(lower(coalesce({x}, '')), '(?m)^[^\\n\\pL]*(copyright|\\(c\\)|©)[^\\n]*[0-9]{{4}}[^\\n]*$', '', 'g')"
        for a, b in SPELLINGS:
            out = f"replace({out}, '{a}', '{b}')"
        return f"md5(trim(regexp_replace({out}, '[^\\pL\\pN]+', ' ', 'g')))"

    values = ", ".join("({}, '{}', '{}')".format(i, n, t.replace("'", "''")) for i, (n, t) in enumerate(known))
    return f"""
WITH known AS (SELECT {form('t')} AS digest, arg_min(n, i) AS name FROM (VALUES {values}) v(i, n, t) GROUP BY 1),
d AS (SELECT doc_id, {form('text')} AS digest,
        [s FOR s IN string_split(coalesce(text, ''), chr(10)) IF trim(s) <> ''] AS lines FROM documents),
l AS (SELECT doc_id, string_agg(DISTINCT name, ',' ORDER BY name) AS notices
      FROM (SELECT doc_id, {form('s')} AS digest FROM (SELECT doc_id, unnest(lines) AS s FROM d)) JOIN known USING (digest) GROUP BY doc_id)
SELECT d.doc_id, d.digest, known.name AS license, len(d.lines)::BIGINT AS n_lines, coalesce(l.notices, '') AS notices
FROM d LEFT JOIN known USING (digest) LEFT JOIN l ON l.doc_id = d.doc_id
"""
