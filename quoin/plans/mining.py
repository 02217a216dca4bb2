"""Queries over pages and manuscripts."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.operators import mining as m
from quoin.plans.registry import query

STRIP = r"regexp_replace({}, '^[\s\x{{A0}}\x{{202F}}]+|[\s\x{{A0}}\x{{202F}}]+$', '', 'g')"
LINES = "line AS (SELECT doc_id, unnest(range(len(string_split(text, chr(10))))) AS page_num, unnest(string_split(text, chr(10))) AS text FROM {documents})"
WORDS = r"len(list_filter(regexp_split_to_array(text, '[\s\x{A0}\x{202F}]+'), lambda w: w <> ''))"


def strip(c: str) -> str:
    return STRIP.format(c)


query("s01_pages", ["documents"], m.pages_of, f"WITH {LINES} SELECT * FROM line")
query("t01_word_count", ["documents"], lambda d: m.word_counts(m.pages_of(d)), f"WITH {LINES} SELECT doc_id, page_num, {WORDS} AS word_count FROM line")
query("a10_totals", ["documents"], lambda d: m.totals(m.pages_of(d)), f"WITH {LINES} SELECT doc_id, count(*) AS total_pages, sum({WORDS})::BIGINT AS total_words FROM line GROUP BY doc_id")

LOWER = m.LOWER
NORMAL = rf"regexp_replace(regexp_replace(regexp_replace(replace(text, chr(173), ''), '-\n([{LOWER}])', '-\1', 'g'), ' {{2,}}', ' ', 'g'), '([{LOWER},;:])\n([{LOWER}])', '\1 \2', 'g')"
query("t18_joined_lines", ["manuscript"], m.normalised, f"SELECT doc_id, page_num, {NORMAL} AS text FROM {{manuscript}}")
FULL = "full_ AS (SELECT doc_id, string_agg(chr(10) || chr(10) || '[PAGE ' || (page_num + 1) || ']' || chr(10) || text, '' ORDER BY page_num) AS full_text FROM {manuscript} GROUP BY doc_id)"
query("t02_full_text", ["manuscript"], m.full_text, f"WITH {FULL} SELECT * FROM full_")
query(
    "t19_section_hash",
    ["manuscript"],
    lambda p: m.full_text(p).select("doc_id", F.substring(F.sha2(F.concat_ws(":", F.lit("roman"), "full_text"), 256), 1, 16).alias("section_hash")),
    f"WITH {FULL} SELECT doc_id, substr(sha256('roman:' || full_text), 1, 16) AS section_hash FROM full_",
)

MONTH = rf"(?i)\b(?:\d{{1,2}}\s+)?(?:{m.MONTHS})\s+\d{{4}}\b"
NUMERIC = r"\b(?:\d{1,2}/\d{1,2}/\d{4}|\d{1,2}-\d{1,2}-\d{4}|\d{1,2}\.\d{1,2}\.\d{4})\b"
YEAR = r"\ben\s\d{4}\b|\bvers\s\d{4}\b|\(\d{4}\)"


def found(kind: int, pattern: str, around: int, lead: str = "0") -> str:
    """Hits of a pattern with their places; lead: how far the hit itself begins behind them."""
    return rf"""
      SELECT doc_id, page_num, {kind} AS kind, i AS nth, text, h[i + 1] AS hit, {around} AS around,
        list_sum(list_transform(p[:i + 1], lambda x: length(x)))::INT + coalesce(list_sum(list_transform(h[:i], lambda x: length(x))), 0)::INT AS start
      FROM (SELECT *, unnest(range(len(h))) AS i FROM (SELECT doc_id, page_num, text, regexp_extract_all(text, '{pattern}') AS h, regexp_split_to_array(text, '{pattern}') AS p FROM {{manuscript}}))"""


DATES = rf"""hit_ AS ({found(1, MONTH, 60)} UNION ALL {found(2, NUMERIC, 60)} UNION ALL {found(3, YEAR, 80)}),
  bare AS (SELECT doc_id, page_num, kind, nth, text, around, CASE WHEN kind = 3 THEN regexp_extract(hit, '\d{{4}}') ELSE hit END AS date_text,
    start + CASE WHEN kind = 3 AND hit LIKE 'en%' THEN 3 WHEN kind = 3 AND hit LIKE 'vers%' THEN 5 ELSE 0 END AS start,
    start + length(hit) AS stop FROM hit_),
  dated AS (SELECT doc_id, page_num, kind, nth, date_text, {strip("replace(substr(text, greatest(0, start - around) + 1, stop + around - greatest(0, start - around)), chr(10), ' ')")} AS context FROM bare)"""
for key, kind in (("t03_date_month", 1), ("t04_date_numeric", 2), ("t05_year_alone", 3)):
    query(key, ["manuscript"], lambda p, kind=kind: m.dates(p).where(F.col("kind") == kind).select("doc_id", "page_num", "nth", "date_text"), f"WITH {DATES} SELECT doc_id, page_num, nth, date_text FROM dated WHERE kind = {kind}")
query("t06_date_context", ["manuscript"], m.dates, f"WITH {DATES} SELECT * FROM dated")
query("t14_first_dates", ["manuscript"], m.first_dates, f"WITH {DATES} SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, kind, nth) AS seq FROM dated) WHERE seq <= 30")

RUN = r"[A-ZÀ-Ü][a-zà-ü\-]{1,}"
NOUN = rf"regexp_extract_all(text, '(?:^|[^\pL\pN_])({RUN}(?:\s+(?:de\s+|d'')?{RUN}){{1,3}})', 1)"
COMMON = "[" + ", ".join(f"'{w}'" for w in m.COMMON_WORDS) + "]"
VALID = rf"""(NOT regexp_matches(name, '[\r\n]') AND len(regexp_split_to_array(name, '\s+')) >= 2
  AND len(list_filter(regexp_split_to_array(name, '\s+'), lambda w: NOT list_contains({COMMON}, w))) > 0
  AND len(list_filter(regexp_split_to_array(name, '\s+'), lambda w: length(w) >= 3)) > 0
  AND len(list_filter(regexp_split_to_array(name, '\s+'), lambda w: length(w) = 1 AND w <> upper(w))) = 0)"""
NOUNS = f"noun AS (SELECT doc_id, page_num, unnest({NOUN}) AS name FROM {{manuscript}})"
NAMES = f"{NOUNS}, name_ AS (SELECT doc_id, name, nth FROM (SELECT doc_id, name, row_number() OVER (PARTITION BY doc_id ORDER BY name) AS nth FROM (SELECT DISTINCT doc_id, name FROM noun WHERE {VALID})) WHERE nth <= 80)"
query("t07_proper_nouns", ["manuscript"], m.proper_nouns, f"WITH {NOUNS} SELECT * FROM noun")
query("t07_proper_nouns_prose", ["documents"], (lambda d: m.proper_nouns(m.pages_of(d)).groupBy("doc_id").agg(F.count("*").alias("n_names"))), f"WITH {LINES} SELECT doc_id, count(*) AS n_names FROM (SELECT doc_id, unnest({NOUN}) FROM line) GROUP BY doc_id")
query("t08_valid_names", ["manuscript"], lambda p: m.proper_nouns(p).withColumn("valid", m.valid_name(F.col("name"))), f"WITH {NOUNS} SELECT *, {VALID} AS valid FROM noun")
query("t09_names", ["manuscript"], m.names, f"WITH {NAMES} SELECT * FROM name_")


def titled(kind: int, pattern: str) -> str:
    return f"SELECT doc_id, page_num, {kind} AS kind, unnest(range(len(h))) AS nth, {strip('unnest(h)')} AS title FROM (SELECT doc_id, page_num, regexp_extract_all(text, '{pattern}', 1) AS h FROM {{manuscript}})"


TITLES = rf"""title_ AS (SELECT * FROM ({titled(1, m.TITLE_QUOTED)} UNION ALL {titled(2, m.TITLE_MARKED)}) WHERE len(list_filter(regexp_split_to_array(title, '\s+'), lambda w: w <> '')) >= 2),
  uniq AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, title ORDER BY page_num, kind, nth) AS rank FROM title_) WHERE rank = 1),
  best AS (SELECT doc_id, page_num, title, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, kind, nth) AS seq, kind FROM uniq)"""
query("t12_titles", ["manuscript"], m.titles, f"WITH {TITLES} SELECT doc_id, page_num, title, seq FROM best WHERE seq <= 30")
for key, pattern in (("t10_titles_quoted", m.TITLE_QUOTED), ("t11_titles_marked", m.TITLE_MARKED)):
    query(
        key,
        ["manuscript"],
        lambda p, pattern=pattern: p.select("doc_id", "page_num", F.explode(F.expr(f"regexp_extract_all(text, {m.literal(pattern)}, 1)")).alias("title")).withColumn("title", m.strip("title")).where(F.size(m.words("title")) >= 2),
        f"SELECT doc_id, page_num, title FROM ({titled(1, pattern)}) WHERE len(list_filter(regexp_split_to_array(title, '\\s+'), lambda w: w <> '')) >= 2",
    )
HOLDER = r"(?i)(?:XX+[-–]?XX*|X{2,}|Xxxxx+|ILLU\s*\w*|TBD|TODO|À\s+COMPLÉTER|N\.?A\.?)"
query("t13_placeholders", ["manuscript"], m.placeholders, rf"SELECT DISTINCT doc_id, {strip('placeholder')} AS placeholder FROM (SELECT doc_id, unnest(regexp_extract_all(text, '(?:^|[^\pL\pN_])({HOLDER})(?:\b|$)', 1)) AS placeholder FROM {{manuscript}})")
FORMS = rf"""{NAMES}, {FULL}, run AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(full_text, '(?:^|[^\pL\pN_])({RUN}(?:\s+{RUN}){{1,3}})', 1)) AS form FROM full_),
  form_ AS (SELECT n.doc_id, n.name, r.form FROM name_ n JOIN run r ON r.doc_id = n.doc_id AND regexp_split_to_array(r.form, '\s+')[1] = regexp_split_to_array(n.name, '\s+')[1] UNION SELECT doc_id, name, name FROM name_)"""
query("t15_variants", ["manuscript"], m.variants, f"WITH {FORMS} SELECT * FROM form_")
COUNTED = f"{FORMS}, counted AS (SELECT doc_id, form, ((length(full_text) - length(replace(full_text, form, ''))) // length(form))::INT AS n FROM (SELECT DISTINCT doc_id, form FROM form_) JOIN full_ USING (doc_id))"
query("t16_substring_count", ["manuscript"], lambda p: m.attested(p, 0), f"WITH {COUNTED} SELECT * FROM counted")
query("i04_attested_names", ["manuscript"], m.attested, f"WITH {COUNTED} SELECT * FROM counted WHERE n >= 2")
query(
    "a20_name_telemetry",
    ["manuscript"],
    lambda p: m.variants(p).groupBy("doc_id", "name").agg(F.count("*").alias("forms")).groupBy("doc_id").agg(F.count("*").alias("names"), F.count_if(F.col("forms") > 1).alias("with_variants")),
    f"WITH {FORMS} SELECT doc_id, count(*) AS names, count(*) FILTER (forms > 1) AS with_variants FROM (SELECT doc_id, name, count(*) AS forms FROM form_ GROUP BY doc_id, name) GROUP BY doc_id",
)
query("t17_first_page", ["manuscript"], lambda p: m.first_page(p, m.names(p).select("doc_id", "name"), "name"), f"WITH {NAMES} SELECT n.doc_id, n.name, coalesce(min(page_num), 0) AS page_num FROM name_ n LEFT JOIN {{manuscript}} p ON p.doc_id = n.doc_id AND contains(p.text, n.name) GROUP BY n.doc_id, n.name")
