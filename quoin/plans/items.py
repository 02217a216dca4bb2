"""Queries over facts to be checked and over the two external checkers."""

from __future__ import annotations

from pyspark.sql import functions as F

from quoin.functions.text import MARKED, UNMARKED
from quoin.operators import items as i
from quoin.operators import mining as m
from quoin.plans.corrections import listed
from quoin.plans.mining import COUNTED, DATES, NAMES, TITLES, strip
from quoin.plans.registry import query

VALID = lambda x: rf"(length({strip(x)}) >= 4 AND NOT regexp_matches({strip(x)}, '^\d+$') AND regexp_matches({strip(x)}, '[a-zA-ZÀ-ÿ]'))"
query("i01_item_validity", ["raw"], lambda r: r.select("id", i.valid(F.col("original")).alias("ok")), f"SELECT id, {VALID('original')} AS ok FROM {{raw}}")
query("i02_search_validity", ["raw"], lambda r: r.select("id", i.valid_for_search(F.col("original")).alias("ok")), f"SELECT id, {VALID('original')} AND NOT regexp_matches({strip('original')}, '^[A-Z0-9.\\-]{{1,6}}$') AS ok FROM {{raw}}")
TYPE = "CASE WHEN item_type IN ('date', 'proper_noun', 'title') THEN item_type ELSE 'proper_noun' END"
HINTS = f"""hint AS (SELECT id, job_id, seq, t AS text, {TYPE} AS item_type, substr(coalesce(description, t), 1, 300) AS context, coalesce(page_hint, page_number + 1) AS page_hint
  FROM (SELECT *, {strip("coalesce(original, '')")} AS t FROM {{raw}}) WHERE length(t) >= 3)"""
query("p11_hints_clean", ["raw"], i.hints_clean, f"WITH {HINTS} SELECT * FROM hint")
query("p12_hint_dedupe", ["raw"], lambda r: i.first_by(i.hints_clean(r).withColumn("_k", F.lower("text")), ["job_id", "_k", "item_type"], ["seq"]).select("id"), f"WITH {HINTS} SELECT id FROM (SELECT id, row_number() OVER (PARTITION BY job_id, lower(text), item_type ORDER BY seq) AS n FROM hint) WHERE n = 1")
ITEMS = f"""{HINTS}, item AS (SELECT job_id, seq, text AS original_text, substr(coalesce(nullif(context, ''), text), 1, 300) AS context, greatest(0, page_hint - 1) AS page_num, {TYPE} AS item_type
  FROM (SELECT *, row_number() OVER (PARTITION BY job_id, text ORDER BY seq) AS n FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id ORDER BY seq) AS r FROM hint) WHERE r <= 50) WHERE text <> '') WHERE n = 1)"""
query("i05_hint_items", ["raw"], lambda r: i.hint_items(i.hints_clean(r)), f"WITH {ITEMS} SELECT * FROM item")
FIRST = f"{DATES}, fd AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY page_num, kind, nth) AS seq FROM dated) WHERE seq <= 20)"
DITEMS = f"{FIRST}, ditem AS (SELECT doc_id, seq, date_text AS original_text, substr(context, 1, 300) AS context, page_num, 'date' AS item_type FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, date_text ORDER BY seq) AS n FROM fd) WHERE n = 1 AND date_text <> '')"
query("i06_date_items", ["manuscript"], i.date_items, f"WITH {DITEMS} SELECT * FROM ditem")
own = lambda r: i.hint_items(i.hints_clean(r)).select(F.substring("job_id", 4, 20).cast("long").alias("doc_id"), "seq", "original_text", "context", "page_num", "item_type").withColumn("seq", F.col("seq").cast("int"))
query(
    "i07_merged_items",
    ["raw", "manuscript"],
    lambda r, p: i.merged_items(own(r), i.date_items(p)).select("doc_id", "original_text", "item_type", "page_num"),
    f"WITH {ITEMS}, {DITEMS} SELECT substr(job_id, 4)::BIGINT AS doc_id, original_text, item_type, page_num FROM item UNION ALL SELECT doc_id, original_text, item_type, page_num FROM ditem d WHERE NOT EXISTS (SELECT 1 FROM item WHERE substr(job_id, 4)::BIGINT = d.doc_id AND lower(item.original_text) = lower(d.original_text))",
)
ONLY = rf"""{FIRST}, {NAMES}, {TITLES},
  stage AS (SELECT doc_id, 1 AS stage, seq AS nth, date_text AS text, substr(context, 1, 300) AS context, page_num, 'date' AS item_type FROM fd
    UNION ALL SELECT n.doc_id, 2, n.nth, n.name, n.name, coalesce(min(p.page_num), 0)::INT, 'proper_noun' FROM name_ n LEFT JOIN {{manuscript}} p ON p.doc_id = n.doc_id AND contains(p.text, n.name) WHERE n.nth <= 15 GROUP BY n.doc_id, n.nth, n.name
    UNION ALL SELECT doc_id, 3, seq, title, title, page_num, 'title' FROM best WHERE seq <= 10),
  once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, text ORDER BY stage, nth) AS n FROM stage WHERE text <> '') WHERE n = 1),
  only_ AS (SELECT doc_id, text, context, page_num, item_type, seq FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY stage, nth) AS seq FROM once) WHERE seq <= 40)"""
query("i08_fact_only_items", ["manuscript"], i.fact_only_items, f"WITH {ONLY} SELECT * FROM only_")
query(
    "i09_prompt",
    ["manuscript"],
    lambda p: i.prompt(i.fact_only_items(p)),
    f"""WITH {ONLY} SELECT doc_id, 'Éléments à vérifier :' || chr(10) || string_agg(chr(10) || seq || '. [' || CASE item_type WHEN 'date' THEN 'Date historique' WHEN 'title' THEN 'Titre d''œuvre' ELSE 'Nom propre' END || '] « ' || text || ' » (page ' || (page_num + 1) || ')'
      || CASE WHEN {strip('context')} <> {strip('text')} THEN chr(10) || '   Contexte : ' || substr(context, 1, 200) ELSE '' END, chr(10) ORDER BY seq) AS prompt FROM only_ GROUP BY doc_id""",
)
query(
    "i03_attested_exclusion",
    ["manuscript"],
    lambda p: (lambda items: items.join(m.attested(p).select("doc_id", F.col("form").alias("text"), F.lit("proper_noun").alias("item_type")), ["doc_id", "text", "item_type"], "left_anti").select("doc_id", "text", "item_type"))(i.fact_only_items(p)),
    f"WITH {ONLY}, {COUNTED[len(NAMES) + 2 :]} SELECT doc_id, text, item_type FROM only_ o WHERE NOT (item_type = 'proper_noun' AND EXISTS (SELECT 1 FROM counted c WHERE c.doc_id = o.doc_id AND c.form = o.text AND c.n >= 2))",
)
query(
    "p13_anomalies",
    ["raw"],
    lambda r: i.anomalies(r, i.hint_items(i.hints_clean(r))),
    f"""WITH {ITEMS}, t AS MATERIALIZED (SELECT *, {strip("coalesce(original, '')")} AS o, nullif({strip("coalesce(corrected, '')")}, '') AS c FROM {{raw}})
      SELECT t.id, coalesce(t.page_hint, item.page_num, 0) AS page_num, 'H' AS category, o AS original_text, c AS corrected_text, CASE item.item_type WHEN 'date' THEN 'Vérification suggérée : date historique' WHEN 'title' THEN 'Vérification suggérée : titre d''œuvre' ELSE 'Vérification suggérée : orthographe du nom propre' END AS description,
        substr(coalesce(explanation, ''), 1, 1000) AS explanation, substr(coalesce(source, ''), 1, 300) AS source, 'À vérifier' AS confidence
      FROM t LEFT JOIN item ON item.job_id = t.job_id AND item.original_text = o WHERE o <> '' AND coalesce(lower(o) <> lower(c), true)""",
)
ANY = lambda x, values: f"len(list_filter([{listed(values)}], lambda v: contains({x}, v))) > 0"
DECOR = rf"({strip('original')} = '' OR regexp_matches({strip('original')}, '^[\s.\-–—_·•…]{{3,}}$') OR (length({strip('original')}) > 2 AND (length({strip('original')}) - length(translate({strip('original')}, '{i.PUNCTUATION}', ''))) / length({strip('original')}) > 0.6))"
TITLE = f"(length({strip('context')}) < 80 AND NOT {ANY('lower(' + strip('context') + ')', i.VERB_MARKS)})"
TYPO = f"(rule_id IN ({listed(i.TYPOGRAPHY_RULES)}) OR upper(category_id) IN ({listed(i.TYPOGRAPHY_CATEGORIES)}) OR {ANY('upper(rule_id)', i.TYPOGRAPHY_WORDS)} OR {ANY('upper(category_id)', i.TYPOGRAPHY_WORDS)})"
query("i10_decorative", ["matches"], lambda x: x.select("id", i.decorative(F.col("original")).alias("decorative")), f"SELECT id, {DECOR} AS decorative FROM {{matches}}")
query("i11_title_context", ["matches"], lambda x: x.select("id", i.title_like(F.col("context")).alias("title")), f"SELECT id, {TITLE} AS title FROM {{matches}}")
query("i12_typographic", ["matches"], lambda x: x.select("id", i.typographic(F.col("rule_id"), F.col("category_id")).alias("typographic")), f"SELECT id, {TYPO} AS typographic FROM {{matches}}")
query("i13_match_chain", ["matches"], lambda x: i.typography_matches(x).select("id"), f"SELECT id FROM {{matches}} WHERE rule_id NOT IN ({listed(i.SKIPPED_RULES)}) AND NOT {ANY('message', i.SKIPPED_MESSAGES)} AND {TYPO} AND {strip('original')} <> '' AND NOT {DECOR} AND NOT (rule_id IN ({listed(i.SENTENCE_END_RULES)}) AND {TITLE})")
query("i14_junk_metadata", ["customer"], lambda k: k.select("c_custkey", F.when(F.lower("c_mktsegment").isin("building", "unknown", "untitled") | (F.length("c_mktsegment") <= 2), "").otherwise(F.col("c_mktsegment")).alias("author")), "SELECT c_custkey, CASE WHEN lower(c_mktsegment) IN ('building', 'unknown', 'untitled') OR length(c_mktsegment) <= 2 THEN '' ELSE c_mktsegment END AS author FROM {customer}")

# ── search checker ─────────────────────────────────────────────────────────

FOLD = lambda x: f"translate(lower({x}), '{MARKED}', '{UNMARKED}')"
LONG = lambda x: rf"list_filter(regexp_split_to_array({x}, '[^\pL\pN_]+'), lambda w: regexp_full_match(w, '[a-zA-ZÀ-ÿ]{{4,}}'))"
BOTH = "concat_ws(' ', results, answer)"


def share(strict: bool) -> str:
    some = "" if strict else f" WHEN length(w) >= 5 AND contains({FOLD(BOTH)}, {FOLD('w')}[:5]) THEN 0.7::DOUBLE WHEN contains({FOLD(BOTH)}, {FOLD('w')}[:4]) THEN 0.5::DOUBLE"
    return f"list_sum(list_transform({LONG('text')}, lambda w: CASE WHEN contains({FOLD(BOTH)}, {FOLD('w')}) THEN 1.0::DOUBLE{some} ELSE 0.0::DOUBLE END)) / nullif(len({LONG('text')}), 0)"


BARE = lambda x: f"replace(lower({x}), ' ', '')"
OWN = "replace(regexp_replace(lower(text), '^[()]+|[()]+$', '', 'g'), ' ', '')"
FORMS = [rf"(?i)\b\d{{1,2}}\s+(?:{i.FR_MONTHS})\s+\d{{4}}\b", rf"(?i)\b(?:{i.FR_MONTHS})\s+\d{{4}}\b", r"\b\d{4}\b"]
RIGHT_DATE = "coalesce(" + ", ".join(f"CASE WHEN regexp_extract(answer, '{f}') <> '' AND {BARE(f'regexp_extract(answer, {chr(39)}{f}{chr(39)})')} <> {OWN} THEN regexp_extract(answer, '{f}') END" for f in FORMS) + ")"
RIGHT_NAME = rf"list_filter(regexp_extract_all(results, '(?:^|[^\pL\pN_])([A-ZÀ-Ü][a-zà-ü\-]{{2,}}(?:\s+[A-ZÀ-Ü][a-zà-ü\-]{{2,}})+)', 1), lambda p: {FOLD('p')} <> {FOLD('text')} AND abs(length(p) - length(text)) <= 4 AND {FOLD('p')}[:4] = {FOLD('text')}[:4])[1]"
RIGHT_TITLE = rf"""list_filter(list_transform(regexp_extract_all(results, '[«“"]([^»”"]{{5,80}})[»”"]', 1), lambda t: {strip('t')}), lambda t: len(list_intersect({LONG('t')}, {LONG('text')})) > 0 AND lower(t) <> lower(text))[1]"""
query("t20_search_query", ["searches"], lambda s: s.select("doc_id", "page_num", i.search_query(F.col("item_type"), F.col("text"), F.col("context")).alias("q")), "SELECT doc_id, page_num, CASE item_type WHEN 'date' THEN context || ' date exacte historique' WHEN 'title' THEN text || ' livre roman auteur date publication' ELSE text || ' écrivain auteur biographie' END AS q FROM {searches}")
query("t21_correct_date", ["searches"], lambda s: s.select("doc_id", "page_num", i.correct_date(F.col("text"), "answer").alias("found")), f"SELECT doc_id, page_num, {RIGHT_DATE} AS found FROM {{searches}}")
query("t22_correct_name", ["searches"], lambda s: s.select("doc_id", "page_num", i.correct_name(F.col("text"), F.col("results")).alias("found")), f"SELECT doc_id, page_num, {RIGHT_NAME} AS found FROM {{searches}}")
query("t23_correct_title", ["searches"], lambda s: s.select("doc_id", "page_num", i.correct_title(F.col("text"), F.col("results")).alias("found")), f"SELECT doc_id, page_num, {RIGHT_TITLE} AS found FROM {{searches}}")
for key, strict in (("t24_keyword_share", False), ("t24_keyword_share_strict", True)):
    query(key, ["searches"], lambda s, strict=strict: s.select("doc_id", "page_num", i.keyword_share(F.col("text"), F.concat_ws(" ", "results", "answer"), strict).alias("share"), i.keyword_match(F.col("text"), F.concat_ws(" ", "results", "answer"), strict).alias("ok")), f"SELECT doc_id, page_num, {share(strict)} AS share, coalesce({share(strict)} >= 0.55, true) AS ok FROM {{searches}}")
SQUEEZED = lambda x: f"replace({FOLD(x)}, ' ', '')"
query(
    "t25_fact_verdict",
    ["searches"],
    lambda s: i.verdicts(s).select("doc_id", "page_num", "category", "corrected_text", "description", "confidence"),
    f"""SELECT doc_id, page_num, CASE WHEN item_type = 'proper_noun' THEN 'A' ELSE 'H' END AS category, CASE item_type WHEN 'date' THEN CASE WHEN results IS NOT NULL THEN {RIGHT_DATE} END WHEN 'title' THEN {RIGHT_TITLE} ELSE {RIGHT_NAME} END AS corrected_text,
      CASE WHEN item_type = 'date' AND results IS NULL THEN 'Date non vérifiable en ligne' WHEN item_type = 'date' THEN 'Date non confirmée — à vérifier' WHEN item_type = 'title' THEN 'Titre d''œuvre introuvable — à vérifier' ELSE 'Orthographe du nom propre à vérifier' END AS description,
      CASE WHEN item_type = 'date' AND results IS NULL THEN 'low' ELSE 'medium' END AS confidence
    FROM {{searches}} WHERE NOT CASE item_type WHEN 'date' THEN results IS NOT NULL AND contains({SQUEEZED(BOTH)}, {SQUEEZED('text')}) WHEN 'title' THEN results IS NULL OR coalesce({share(False)} >= 0.55, true) ELSE results IS NULL OR coalesce({share(True)} >= 0.55, true) END""",
)
