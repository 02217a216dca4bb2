"""License scan by canonical digest, in DataFrame functions only.

A text is brought to a canonical form: lower case, punctuation, list numbers and white space as
single blanks, lines that state a copyright or reserve all rights taken out, spellings that
count as equal made one. The digest of an entire canonical text is hash-joined with the digests
of known license texts.

A document's units are its runs of lines: the whole, and every run of it that begins with the
first words of some known text and has as many words as one. The words in which two spellings
differ by a blank ("sub license") make a unit up to so many words longer; the numbers of words
that are tried allow for that, so no equal text is lost. Only those few runs are digested.

The known texts are a list or a table (license, text) of any size, to which digests of texts
that are not at hand may be added, as ``digested`` gives them. Up to ``MOST_TEXTS`` of them
the digests are broadcast and the first words are tried by a hash set; a longer table is joined
by shuffle and every line begins a unit.

Null and empty texts match nothing, very long ones are scanned whole, and a table without rows
gives none. Repeated rows are scanned one by one. ``scan`` carries the other columns along,
except those named as its results.
"""

from __future__ import annotations

from itertools import product

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import guarded, read, text_or_empty
from quoin.session import cut

MOST_TEXTS = 10_000

# Spellings that license texts may have either way.
SPELLINGS = {
    "acknowledgement": "acknowledgment",
    "analogue": "analog",
    "authorisation": "authorization",
    "authorised": "authorized",
    "cancelled": "canceled",
    "centre": "center",
    "favour": "favor",
    "fulfil": "fulfill",
    "initialise": "initialize",
    "judgement": "judgment",
    "labour": "labor",
    "licence": "license",
    "licenced": "licensed",
    "licences": "licenses",
    "modelled": "modeled",
    "organisation": "organization",
    "practise": "practice",
    "programme": "program",
    "realise": "realize",
    "recognise": "recognize",
    "sublicence": "sublicense",
    "unlicence": "unlicense",
    "utilisation": "utilization",
    "whilst": "while",
    "wilful": "willful",
}

# Public license texts and the notices that stand for them.
_MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
_ISC = """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
_BSD_TAIL = """THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
_BSD_HEAD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
"""
_BSD_THIRD = """3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
"""
KNOWN = [
    ("MIT", _MIT),
    ("MIT", "MIT License\n\n" + _MIT),
    ("MIT", "The MIT License\n\n" + _MIT),
    ("MIT", "The MIT License (MIT)\n\n" + _MIT),
    ("ISC", _ISC),
    ("ISC", "ISC License\n\n" + _ISC),
    ("ISC", "The ISC License\n\n" + _ISC),
    ("BSD-2-Clause", _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-2-Clause", "BSD 2-Clause License\n\n" + _BSD_HEAD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", _BSD_HEAD + _BSD_THIRD + "\n" + _BSD_TAIL),
    ("BSD-3-Clause", "BSD 3-Clause License\n\n" + _BSD_HEAD + _BSD_THIRD + "\n" + _BSD_TAIL),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0-only", "This work is licensed under the GNU General Public License, version 3."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    *((name, f"SPDX-License-Identifier: {name}") for name in ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later", "MPL-2.0", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "Unlicense")),
]
# Fixed values: (license, words, words that may be two, digest, first words) of full public texts, by ``digested``.
FULL_TEXTS = [
    ("Apache-2.0", 1592, 3, "2e395a8c89bc57e58e61b5f397a762ee419e61392201c30407f9347a02bfe64f", "apache license version 2"),
    ("Artistic-1.0-Perl", 973, 0, "0ce87c1a2f9de8bd07685d372028374149e71fffb4eab93598a4cdc00ed86780", "the artistic license preamble"),
    ("CC0-1.0", 1083, 2, "adf75bc38a3fbbdcbadda90b262623acbb176db40d4de0538e4bddaa4c7f8d2a", "creative commons legal code"),
    ("GFDL-1.2", 3304, 2, "c015dc0a33d4b0c9904c69fb6954d48550fa3a94f315fa7f95f494ff6b782e11", "gnu free documentation license"),
    ("GFDL-1.3", 3720, 2, "f2edd528e4cc98575959cba69684ad13f50b975e3a4f932d229b16c4db1b21ed", "gnu free documentation license"),
    ("GPL-1.0", 2044, 2, "37ad91aa6172cbff0a7040958872ecbb3c833741cfd15476cff10519f35b960a", "gnu general public license"),
    ("GPL-2.0", 2962, 2, "82a6cca2aba6d89ca2af2de0d09a06af62f784080c8095ea0b6303dfc3c0221a", "gnu general public license"),
    ("GPL-3.0", 5653, 2, "2fca3a8de98837a877c08ec04bd45136e1e2cb44b52362129262de323de489bd", "gnu general public license"),
    ("LGPL-2.0", 4171, 2, "42687cff933741dd38483028b5ccec0285d588be4f244a69f1b62fb868628db3", "gnu library general public"),
    ("LGPL-2.1", 4372, 2, "f59bc185a809cfe3453dde565669c92a333ef5ff5d4d92634bdf71e87397cce4", "gnu lesser general public"),
    ("LGPL-3.0", 1222, 0, "828c3944cde1fc14c68737c9be14d8d0f4f13ab980f8a72364a0e64f72965525", "gnu lesser general public"),
    ("MPL-1.1", 3772, 4, "37cab2ee073d274b84c604b91f5bdbacc05cefd41c228d31be699eec6cb6ef97", "mozilla public license version"),
    ("MPL-2.0", 2418, 2, "0ecc021d359a14565d7811156d226bdff6bc633005f6877234117e20cdb1e3c2", "mozilla public license version"),
]

# Words behind "copyright" in running text, where the line is no notice.
NO_NOTICE = ["notice", "notices", "holder", "holders", "owner", "owners", "license", "licenses", "licence", "law", "laws", "and", "or", "in", "interest", "interests", "act", "statement", "statements", "protection", "treaty", "is", "as", "on", "to", "of", "for", "disclaimer", "under"]
#: What is no word; at a line's start a list number goes with it.
NO_WORD = r"(?m)^[ \t]*[0-9]{1,2}[.)][^\pL\pN\n]+|[^\pL\pN\n]+"
HEAD_WORDS = 4
#: Spellings with a blank, canonical ones without. Longer words that begin so are meant too.
JOINED = {" sub license": " sublicense", " sub licence": " sublicense", " non infringement": " noninfringement", " per cent ": " percent "}
EQUAL = {" copyright owner": " copyright holder", " https ": " http "}


def canonical_lines(text: Column) -> Column:
    """The lines of the canonical form that have words, before spellings are made one."""
    marked = F.replace(F.lower(text), F.lit("©"), F.lit(" copyright "))
    lines = F.transform(F.split(F.regexp_replace(marked, NO_WORD, " "), "\n"), lambda x: F.trim(x))
    word = lambda line, k: F.call_function("split_part", line, F.lit(" "), F.lit(k))
    notice = lambda line: ((word(line, 1) == "copyright") & (word(line, 2) != "") & ~word(line, 2).isin(NO_NOTICE)) | line.rlike("^c [0-9]{4}( |$)")
    return F.filter(lines, lambda line: (line != "") & (line != "all rights reserved") & ~notice(line))


def spelt(joined: Column) -> Column:
    """Words, joined by a blank, in the one spelling of those that count as equal."""
    out = F.concat(F.lit(" "), joined, F.lit(" "))
    for other, one in (JOINED | EQUAL).items():
        out = F.replace(out, F.lit(other), F.lit(one))
    same = F.create_map(*(F.lit(x) for pair in SPELLINGS.items() for x in pair))
    return F.array_join(F.transform(F.split(F.trim(out), " "), lambda w: F.coalesce(same[w], w)), " ")


def digested(known: DataFrame) -> DataFrame:
    """(license, words, joined, digest, head) of texts (license, text): canonical words, those of
    them that may be written as two, digest, and first words. Of one text with several licenses
    the first name counts."""
    rows = known.select("license", spelt(F.array_join(canonical_lines(text_or_empty("text")), " ")).alias("c")).where("c <> ''")
    return with_digest(rows, F.col("c"))


def with_digest(rows: DataFrame, c: Column) -> DataFrame:
    words = F.split(c, " ")
    may_split = F.filter(words, lambda w: w.rlike("^sublicens") | w.isin("noninfringement", "percent"))
    return rows.select("license", F.size(words).alias("words"), F.size(may_split).alias("joined"), F.sha2(c.cast("binary"), 256).alias("digest"), F.array_join(F.slice(words, 1, HEAD_WORDS), " ").alias("head"))


def heads_of(head: str) -> set[str]:
    """The head in all spellings, and cut to fewer words, as a line may have fewer."""
    other: dict[str, list[str]] = {}
    for a, b in SPELLINGS.items():
        other.setdefault(b, []).append(a)
    words = [[w, *other.get(w, [])] for w in head.split(" ")]
    return {" ".join(some) for n in range(1, len(words) + 1) for some in product(*words[:n])}


def runs(lines: str, sizes: list[int], heads: list[str] | None) -> Column:
    """The runs of an array of canonical lines that may be a known text: start and end line, from
    0, the number of lines, and the words of the run."""
    most = max(sizes, default=0)
    begins = F.expr(f"sequence(0, size({lines}) - 1)")
    line = lambda i: F.get(F.col(lines), i)
    if heads is not None:
        # a line of fewer words than a head must be its beginning; one of more begins with it
        begins = F.filter(begins, lambda i: F.call_function("substring_index", line(i), F.lit(" "), F.lit(HEAD_WORDS)).isin(heads))

    def of(i: Column) -> Column:
        some = F.slice(F.col(lines), i + 1, most)
        none = F.struct(F.lit(0).alias("n"), F.array().cast("array<int>").alias("ends"))
        add = lambda n, ends: F.struct(n.alias("n"), F.array_append(ends, n).alias("ends"))
        count = F.aggregate(some, none, lambda acc, x: F.when(acc["n"] > most, acc).otherwise(add(acc["n"] + F.size(F.split(x, " ")), acc["ends"])), lambda acc: acc["ends"])
        ends = F.filter(F.transform(count, lambda n, k: F.struct(n.alias("n"), k.alias("k"))), lambda e: e["n"].isin(sizes))
        return F.transform(ends, lambda e: F.struct(i.alias("start"), (i + e["k"]).alias("end"), F.size(lines).alias("lines"), spelt(F.array_join(F.slice(some, 1, e["k"] + 1), " ")).alias("words")))

    return F.when(F.size(lines) > 0, F.flatten(F.transform(begins, of)))


def scan(docs: DataFrame, known: DataFrame | list[tuple[str, str]] = KNOWN, text: str = "text", digests: list[tuple[str, int, int, str, str]] = FULL_TEXTS) -> DataFrame:
    """The columns of ``docs`` but its text, ``license`` (that of the whole text, or null),
    ``n_notices`` (runs of lines that are a known text and lie in no longer one) and
    ``notices`` (their licenses, sorted)."""
    spark = docs.sparkSession
    texts = known if isinstance(known, DataFrame) else spark.createDataFrame(known, "license string, text string")
    added = spark.createDataFrame(digests, "license string, words int, joined int, digest string, head string")
    table = cut(digested(texts).unionByName(added).groupBy("digest").agg(F.min("license").alias("license"), F.first("words").alias("words"), F.max("joined").alias("joined"), F.first("head").alias("head")))
    few = table.count() <= MOST_TEXTS
    counts = table.select(F.explode(F.expr("sequence(words, words + joined)")).alias("n")).distinct()
    sizes = sorted(r.n for r in counts.collect())
    heads = sorted(set().union(*(heads_of(r["head"]) for r in table.select("head").distinct().collect()))) if few else None

    own, back = guarded(docs, [text, "license", "n_notices", "notices"])
    keep = [f"_c{i}" for i in range(len(own))]
    lined = docs.select(*own, F.monotonically_increasing_id().alias("_row"), canonical_lines(text_or_empty(text)).alias("_lines"))
    units = lined.select(*keep, "_row", F.explode_outer(runs("_lines", sizes, heads)).alias("_u"))
    cited = units.select(*keep, "_row", "_u.start", "_u.end", "_u.lines", F.sha2(F.col("_u.words").cast("binary"), 256).alias("digest"))
    side = table.select("digest", "license")
    met = cited.join(F.broadcast(side) if few else side, "digest", "left")
    hit = F.when(F.col("license").isNotNull(), F.struct("start", (-F.col("end")).alias("back"), "license", "lines"))
    # the row without a unit, or any other, carries the columns of the text
    found = met.groupBy("_row").agg(*(F.first(c).alias(c) for c in keep), F.array_sort(F.collect_list(hit)).alias("hits"))
    # by start, the longest first: what ends no later than one before lies in it
    start = F.struct(F.lit(-1).alias("last"), F.array().cast("array<string>").alias("out"))
    outer = F.aggregate("hits", start, lambda acc, h: F.when(-h["back"] <= acc["last"], acc).otherwise(F.struct((-h["back"]).alias("last"), F.array_append(acc["out"], h["license"]).alias("out"))), lambda acc: acc["out"])
    whole = F.filter("hits", lambda h: (h["start"] == 0) & (-h["back"] == h["lines"] - 1))
    return found.select(*back, F.get(whole, F.lit(0))["license"].alias("license"), F.size(outer).cast("long").alias("n_notices"), F.array_sort(F.array_distinct(outer)).alias("notices"))


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.withColumn("notices", F.array_join("notices", ","))


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spelt(c: str) -> str:
    out = f"' ' || {c} || ' '"
    for other, one in (JOINED | EQUAL).items():
        out = f"replace({out}, '{other}', '{one}')"
    same = "map {" + ", ".join(f"{_quoted(x)}: {_quoted(y)}" for x, y in SPELLINGS.items()) + "}"
    return f"array_to_string(list_transform(string_split(trim({out}), ' '), lambda w: coalesce({same}[w], w)), ' ')"


OP5_SQL = (
    "WITH given(license, t) AS (VALUES " + ", ".join(f"({_quoted(k)}, {_quoted(t)})" for k, t in KNOWN) + "), "
    + "full_(license, words, joined, digest) AS (VALUES " + ", ".join(f"({_quoted(k)}, {n}, {j}, '{d}')" for k, n, j, d, _ in FULL_TEXTS) + "), "
    + f"""both_ AS (
  SELECT doc_id, NULL AS license, coalesce(text, '') AS t FROM documents UNION ALL SELECT NULL, license, t FROM given
), lined AS (
  SELECT doc_id, license, list_filter(list_transform(string_split(regexp_replace(replace(lower(t), '©', ' copyright '), '{NO_WORD}', ' ', 'g'), chr(10)), lambda x: trim(x)),
    lambda x: x <> '' AND x <> 'all rights reserved' AND NOT (split_part(x, ' ', 1) = 'copyright' AND split_part(x, ' ', 2) <> '' AND NOT list_contains([{", ".join(map(_quoted, NO_NOTICE))}], split_part(x, ' ', 2))) AND NOT regexp_matches(x, '^c [0-9]{{4}}( |$)')) AS lines
  FROM both_
), text_ AS (
  SELECT license, {_spelt("array_to_string(lines, ' ')")} AS c FROM lined WHERE license IS NOT NULL
), known AS (
  SELECT digest, min(license) AS license, any_value(words) AS words, max(joined) AS joined FROM (
    SELECT license, len(string_split(c, ' ')) AS words, len(list_filter(string_split(c, ' '), lambda w: starts_with(w, 'sublicens') OR w IN ('noninfringement', 'percent'))) AS joined, sha256(c) AS digest FROM text_
    UNION ALL SELECT license, words, joined, digest FROM full_) GROUP BY digest
), sizes AS (
  SELECT DISTINCT unnest(range(words, words + joined + 1)) AS n FROM known
), line AS (
  SELECT doc_id, len(lines) AS n_lines, unnest(range(len(lines))) AS i, unnest(lines) AS x FROM lined WHERE license IS NULL
), summed AS (
  SELECT *, len(string_split(x, ' ')) AS n, sum(len(string_split(x, ' '))) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM line
), run AS (
  SELECT a.doc_id, a.n_lines, a.i AS first, b.i AS last FROM summed a JOIN summed b ON a.doc_id = b.doc_id AND b.i >= a.i JOIN sizes s ON s.n = b.upto - a.upto + a.n
), worded AS (
  SELECT r.doc_id, n_lines, first, last, {_spelt("array_to_string(lines[first + 1:last + 1], ' ')")} AS c FROM run r JOIN lined l ON l.doc_id = r.doc_id AND l.license IS NULL
), hit AS (
  SELECT *, max(last) OVER (PARTITION BY doc_id ORDER BY first, last DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM worded JOIN known ON sha256(c) = digest
)
SELECT d.doc_id, max(h.license) FILTER (first = 0 AND last = n_lines - 1) AS license, count(h.license) FILTER (before IS NULL OR before < last) AS n_notices,
  coalesce(string_agg(DISTINCT h.license, ',' ORDER BY h.license) FILTER (before IS NULL OR before < last), '') AS notices
FROM documents d LEFT JOIN hit h USING (doc_id) GROUP BY d.doc_id
"""
)
