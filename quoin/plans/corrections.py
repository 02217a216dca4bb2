"""Queries over candidate corrections."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.functions.text import MARKED, SUPERSCRIPTS, UNMARKED, key
from quoin.operators import corrections as c
from quoin.operators import replies
from quoin.plans.mining import strip
from quoin.plans.registry import QUERIES, SQL, query
from quoin.session import shared_folder
from quoin.sources.bridge import frame
from quoin.sources.files import append_rows
from quoin.sources.tables import staged


def listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


# ── parsing ────────────────────────────────────────────────────────────────

TAGS = lambda x: strip(f"regexp_replace({x}, '<[^>]+>', '', 'g')")
query("p02_without_tags", ["raw"], lambda r: r.select("id", c.without_tags("original").alias("original")), f"SELECT id, {TAGS('original')} AS original FROM {{raw}}")
query("p03_length_gate", ["raw"], lambda r: r.where(c.length_ok(F.col("original"))).select("id", "original"), "SELECT id, original FROM {raw} WHERE length(original) > 0 AND length(replace(original, '*', '')) >= 2 AND length(original) <= 150")
for name, allowed in c.PASS_CATEGORIES.items():
    query(f"p04_category_gate_{name}", ["raw"], lambda r, a=allowed: r.where(F.coalesce("category", F.lit("D")).isin(list(a))).select("id", F.coalesce("category", F.lit("D")).alias("category")), f"SELECT id, coalesce(category, 'D') AS category FROM {{raw}} WHERE coalesce(category, 'D') IN ({listed(allowed)})")
query("p05_page_hint", ["raw"], lambda r: r.select("id", c.page_of(F.col("page_hint"), F.col("page_number")).alias("page")), "SELECT id, greatest(0, coalesce(page_hint, page_number + 1) - 1) AS page FROM {raw}")
query("p06_null_corrections", ["raw"], lambda r: r.select("id", c.real_correction(F.coalesce("corrected", F.lit(""))).alias("corrected")), f"SELECT id, CASE WHEN lower(coalesce(corrected, '')) NOT IN ({listed(c.NOT_A_CORRECTION)}) THEN corrected END AS corrected FROM {{raw}}")
query("p07_drop_identity", ["corrections"], lambda r: r.where(F.coalesce(key("corrected_text") != key("original_text"), F.lit(True))).select("id"), f"SELECT id FROM {{corrections}} WHERE coalesce(lower({strip('corrected_text')}) <> lower({strip('original_text')}), true)")
SPLIT = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\s\\x{{A0}}\\x{{202F}}]+'), lambda w: w <> '')"
ONE = f"CASE WHEN len({SPLIT('original_text')}) > 1 AND len({SPLIT('original_text')}) = len({SPLIT('corrected_text')}) AND len(list_filter(list_zip({SPLIT('original_text')}, {SPLIT('corrected_text')}), lambda p: lower(p[1]) <> lower(p[2]))) = 1 THEN list_filter(list_zip({SPLIT('original_text')}, {SPLIT('corrected_text')}), lambda p: lower(p[1]) <> lower(p[2]))[1] END"
query("p08_only_change", ["corrections"], lambda r: r.withColumn("p", c.only_change("original_text", "corrected_text")).where("p IS NOT NULL").select("id", F.col("p.a").alias("original"), F.col("p.b").alias("corrected")), f"SELECT id, p[1] AS original, p[2] AS corrected FROM (SELECT id, {ONE} AS p FROM {{corrections}}) WHERE p IS NOT NULL")
query("p09_confidence", ["raw"], lambda r: r.select("id", F.when(F.col("confidence").isin(c.CONFIDENCES), F.col("confidence")).otherwise("Probable").alias("confidence")), f"SELECT id, CASE WHEN confidence IN ({listed(c.CONFIDENCES)}) THEN confidence ELSE 'Probable' END AS confidence FROM {{raw}}")
SOURCE = "substr(coalesce(nullif(source, ''), '" + c.DEFAULT_SOURCE.replace("'", "''") + "'), 1, 300)"
query("p10_truncation", ["raw"], lambda r: r.select("id", c.shortened("description", 200).alias("description"), c.shortened("explanation", 1000).alias("explanation"), F.coalesce(F.nullif(F.col("source"), F.lit("")), F.lit(c.DEFAULT_SOURCE)).alias("source")), f"SELECT id, substr(coalesce(description, ''), 1, 200) AS description, substr(coalesce(explanation, ''), 1, 1000) AS explanation, {SOURCE} AS source FROM {{raw}}")
for name, allowed in (("p_parse_1a", "ABCD"), ("p_parse_all", "ABCDEFGH")):
    query(
        name,
        ["raw"],
        lambda r, a=allowed: c.parsed(r, a),
        f"""WITH t AS (SELECT *, {TAGS("coalesce(original, '')")} AS original_text, {TAGS("coalesce(corrected, '')")} AS corrected_all, coalesce(category, 'D') AS cat FROM {{raw}}),
        u AS (SELECT *, CASE WHEN lower(corrected_all) NOT IN ({listed(c.NOT_A_CORRECTION)}) THEN corrected_all END AS corrected_text FROM t
          WHERE length(original_text) > 0 AND length(replace(original_text, '*', '')) >= 2 AND length(original_text) <= 150 AND cat IN ({listed(allowed)})),
        v AS (SELECT *, {ONE} AS p FROM u WHERE coalesce(lower({strip('corrected_text')}) <> lower({strip('original_text')}), true))
        SELECT id, job_id, seq, greatest(0, coalesce(page_hint, page_number + 1) - 1) AS page_number, cat AS category, coalesce(p[1], original_text) AS original_text, coalesce(p[2], corrected_text) AS corrected_text,
          substr(coalesce(description, ''), 1, 200) AS description, substr(coalesce(explanation, ''), 1, 1000) AS explanation, {SOURCE} AS source,
          CASE WHEN confidence IN ({listed(c.CONFIDENCES)}) THEN confidence ELSE 'Probable' END AS confidence FROM v""",
    )


def inserted(raw: DataFrame) -> DataFrame:
    """What two passes (A to D, then the rest) insert into one table, read back."""
    path = f"{shared_folder(raw.sparkSession)}/quoin-corrections-{uuid.uuid4().hex}"
    raw = staged(raw)  # the view is made once for both passes
    for categories in ("ABCD", "EFGH"):
        append_rows(c.parsed(raw, categories), path)
    return raw.sparkSession.read.parquet(path)


QUERIES["s11_insert_corrections"] = lambda spark, sf_dir: inserted(frame(spark, sf_dir, "raw"))
SQL["s11_insert_corrections"] = SQL["p_parse_all"]

REPLY = "CASE seq % 4 WHEN 0 THEN '\"texte nu\"' WHEN 1 THEN '{\"x\": 1}' ELSE concat('{\"original\": \"', replace(replace(original_text, '\"', ''), chr(92), ''), '\", \"category\": \"', category, '\"}') END"
query("p01_type_guard", ["corrections"], lambda k: c.only_objects(k.select("id", F.expr(REPLY).alias("reply")), "reply").select("id", "original", "category"), f"SELECT id, reply->>'$.original' AS original, reply->>'$.category' AS category FROM (SELECT id, {REPLY} AS reply FROM {{corrections}}) WHERE json_type(reply) = 'OBJECT' AND (reply->>'$.original' IS NOT NULL OR reply->>'$.category' IS NOT NULL)")
FENCED = "CASE seq % 3 WHEN 0 THEN concat('```json', chr(10), '{\"author\": \"', job_id, '\"}', chr(10), '```') WHEN 1 THEN concat('{\"author\": \"', job_id, '\"}') ELSE '{}' END"
query("p15_unwrap_json", ["corrections"], lambda k: k.withColumn("reply", F.expr(FENCED)).select("id", c.unwrapped("reply", F.when(F.col("seq") % 5 == 0, "Zola").otherwise("")).alias("author")), f"SELECT id, coalesce(CASE WHEN seq % 5 = 0 THEN 'Zola' END, regexp_replace(reply, '^```(?:json)?\\s*|\\s*```$', '', 'g')->>'$.author') AS author FROM (SELECT *, {FENCED} AS reply FROM {{corrections}})")
DIM = ", ".join(str(x) for x in c.CATEGORY)
query("p14_record_shape", ["corrections"], lambda k: c.shaped(k).select("id", "name", "annotation_type", "color_r", "color_g", "color_b"), f"WITH dim(k, name, annotation_type, color_r, color_g, color_b) AS (VALUES {DIM}) SELECT id, name, annotation_type, color_r::DOUBLE AS color_r, color_g::DOUBLE AS color_g, color_b::DOUBLE AS color_b FROM {{corrections}} JOIN dim ON k = CASE WHEN strpos('ABCDEFG', category) > 0 THEN category ELSE 'D' END")

# ── rules ──────────────────────────────────────────────────────────────────

RULES = rf"""marks AS (SELECT job_id, sum(length(t) - length(replace(t, '«', '')))::BIGINT AS g FROM (SELECT job_id, concat_ws(' ', original_text, corrected_text) AS t FROM {{corrections}}) GROUP BY job_id),
  row_ AS (SELECT k.*, g, {strip("coalesce(original_text, '')")} AS o, {strip("coalesce(corrected_text, '')")} AS r, {strip("lower(coalesce(explanation, ''))")} AS e, lower(coalesce(description, '')) AS d FROM {{corrections}} k LEFT JOIN marks USING (job_id)),
  said AS (SELECT *, d || ' ' || e AS s, rtrim(o, '0123456789') AS stem, regexp_replace(o, '[«»"“”‘’\s]', '', 'g') AS ob, regexp_replace(r, '[«»"“”‘’\s]', '', 'g') AS rb, {strip(f"rtrim(o, '{SUPERSCRIPTS}')")} AS ou, {strip(f"rtrim(r, '{SUPERSCRIPTS}')")} AS ru FROM row_),
  ruled AS (SELECT *, CASE
    WHEN len(list_filter([{listed(c.NO_ERROR)}], lambda p: contains(e, p))) > 0 THEN 'explication_negative'
    WHEN o <> '' AND r <> '' AND lower(o) = lower(r) THEN 'original_eq_correction'
    WHEN category = 'C' AND contains(d, 'guillemet') AND regexp_matches(o, '[«»]') THEN 'guillemets_français_présents'
    WHEN category = 'C' AND contains(d, 'guillemet') AND g > 3 AND regexp_matches(r, '[«»]') AND ob <> '' AND ob = rb THEN 'guillemets_extraction_artefact'
    WHEN category = 'C' AND contains(d, 'apostrophe') AND NOT contains(o, '''') THEN 'apostrophe_absente'
    WHEN o <> '' AND r <> '' AND (ou = r OR ou = ru) THEN 'chiffre_renvoi'
    WHEN length(o) < 3 THEN 'texte_trop_court'
    WHEN category IN ('A', 'C') AND regexp_matches(o, '(?i)^[IVXLCDM]{{2,}}e(?:r|re|s)?$') THEN 'siecle_romain'
    WHEN regexp_matches(r, '^[0-9⁰¹²³⁴-⁹]+$') AND starts_with(o, r) AND regexp_matches(substr(o, length(r) + 1), '^[0-9]{{1,2}}$') THEN 'chiffre_renvoi_extrait'
    WHEN o <> '' AND length(r) >= 2 AND NOT regexp_matches(o, '^[0-9⁰¹²³⁴-⁹]+$') AND length(o) - length(stem) BETWEEN 1 AND 2 AND lower(stem) = lower(r) THEN 'chiffre_renvoi_mot_extrait'
    WHEN category = 'C' AND contains(o, '-') AND r <> '' AND lower(r) NOT IN (lower(replace(o, '-', '')), lower(o)) THEN 'coupure_substitution_erronee'
    WHEN contains(upper(d), 'COUPURE SYLLABIQUE') THEN 'coupure_syllabique_artefact'
    WHEN category IN ('A', 'C') AND regexp_matches(o, '(?i)^[0-9]+(?:e|er|eme|ème|ere|ère|s|rs)$') AND regexp_matches(r, '^[0-9]+\s*(?:ᵉ|ʳ|ème|ère|[ᵒᵃ])') THEN 'ordinal_expose_extraction'
    WHEN contains(lower(r), '[texte manquant]') THEN 'phrase_tronquee_artefact'
    WHEN category = 'G' AND (contains(s, 'signalement préventif') OR (contains(s, 'aucun placeholder') AND contains(lower(r), 'compléter'))) THEN 'placeholder_preventif'
    WHEN contains(s, 'saut de ligne') OR contains(s, 'retour à la ligne') THEN 'saut_de_ligne_artefact'
    WHEN category = 'F' AND len(list_filter([{listed(c.SPACING)}], lambda p: contains(s, p))) > 0 THEN 'interligne_mise_en_page'
    WHEN category = 'C' AND (contains(s, 'double espace') OR (contains(o, '  ') AND r <> '' AND NOT contains(r, '  '))) THEN 'double_espace_justification'
  END AS fp_rule FROM said)"""
query("f_rules", ["corrections"], lambda k: c.with_rule(k).select("id", "fp_rule"), f"WITH {RULES} SELECT id, fp_rule FROM ruled")
query("f07_filtered", ["corrections"], lambda k: c.filtered(k).select("id", "category", "confidence"), f"WITH {RULES} SELECT id, category, CASE WHEN category = 'H' AND confidence IN ('Certain', 'Probable') THEN 'À vérifier' ELSE confidence END AS confidence FROM ruled WHERE fp_rule IS NULL")
query("a21_removed_by_rule", ["corrections"], lambda k: c.with_rule(k).where("fp_rule IS NOT NULL").groupBy("fp_rule").agg(F.count("*").alias("removed")), f"WITH {RULES} SELECT fp_rule, count(*) AS removed FROM ruled WHERE fp_rule IS NOT NULL GROUP BY fp_rule")
query(
    "f18_quality_ratios",
    ["corrections"],
    lambda k: c.with_rule(k).groupBy("job_id").agg(F.count("*").alias("raw"), F.count_if(F.col("fp_rule").isNull()).alias("kept")).select("job_id", "raw", "kept", F.round(F.col("kept") / F.col("raw"), 3).alias("kept_ratio"), ((1 - F.col("kept") / F.col("raw")) > 0.4).alias("alert")),
    f"WITH {RULES} SELECT job_id, count(*) AS raw, count(*) FILTER (fp_rule IS NULL) AS kept, round(count(*) FILTER (fp_rule IS NULL) / count(*), 3) AS kept_ratio, (1 - count(*) FILTER (fp_rule IS NULL) / count(*)) > 0.4 AS alert FROM ruled GROUP BY job_id",
)

# ── de-duplication ─────────────────────────────────────────────────────────

KEY = f"lower({strip('original_text')})"
FOLD = f"translate({KEY}, '{MARKED}', '{UNMARKED}')"
for src, dst in (("ﬁ", "fi"), ("ﬂ", "fl"), ("¹", "1"), ("²", "2"), ("³", "3"), ("…", "...")):
    FOLD = f"replace({FOLD}, '{src}', '{dst}')"
PRIO = "CASE WHEN strpos('ABCDEFGH', category) > 0 THEN strpos('ABCDEFGH', category) ELSE 99 END"


def best(source: str, of: str, position: str) -> str:
    return f"""SELECT * EXCLUDE (rn, k0) FROM (SELECT * REPLACE (min({position}) OVER (PARTITION BY job_id, page_number, k0) AS position), row_number() OVER (PARTITION BY job_id, page_number, k0 ORDER BY {PRIO}, {position}) AS rn
      FROM (SELECT *, {of} AS k0 FROM {source})) WHERE rn = 1"""


def dedupe_sql(source: str) -> str:
    return f"""d0 AS (SELECT *, seq AS position FROM {source}), d1 AS ({best('d0', FOLD, 'position')}), d2 AS ({best('d1', KEY, 'position')}),
  ord AS (SELECT *, {KEY} AS k, {PRIO} AS prio, row_number() OVER (PARTITION BY job_id, page_number ORDER BY {PRIO}, position) AS n FROM d2),
  walk AS (SELECT job_id, page_number, n, [k] AS kept, true AS stays FROM ord WHERE n = 1
    UNION ALL SELECT o.job_id, o.page_number, o.n, CASE WHEN len(list_filter(w.kept, lambda y: {c.overlap('o.k', 'y')})) > 0 THEN w.kept ELSE list_append(w.kept, o.k) END, len(list_filter(w.kept, lambda y: {c.overlap('o.k', 'y')})) = 0
    FROM walk w JOIN ord o ON o.job_id = w.job_id AND o.page_number = w.page_number AND o.n = w.n + 1),
  d3 AS (SELECT o.* FROM ord o JOIN walk w USING (job_id, page_number, n) WHERE w.stays),
  d4 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job_id, category, k ORDER BY prio, position) AS nth FROM d3) WHERE category NOT IN ('A', 'B', 'C') OR nth <= 3)"""


DEDUPE = dedupe_sql("{corrections}")
#: Columns that de-duplication reads; what is left out here stays out of its shuffles.
READ = ["id", "job_id", "page_number", "seq", "category", "original_text"]
query("d01_fuzzy_key", ["corrections"], lambda k: c.fuzzy_deduplicated(k).select("id", "position"), f"WITH RECURSIVE {DEDUPE} SELECT id, position FROM d1")
query("d02_exact_key", ["corrections"], lambda k: c.exactly_deduplicated(c.fuzzy_deduplicated(k)).select("id", "position"), f"WITH RECURSIVE {DEDUPE} SELECT id, position FROM d2")
query("d03_overlap", ["corrections"], lambda k: c.undominated(c.paged(k.select(*READ))).select("id", "position"), f"WITH RECURSIVE {DEDUPE} SELECT id, position FROM d3")
query("d04_repeat_cap", ["corrections"], lambda k: c.deduplicated(k.select(*READ)).select("id", "position"), f"WITH RECURSIVE {DEDUPE} SELECT id, position FROM d4")
query("d05_result_order", ["corrections"], lambda k: c.deduplicated(k.select(*READ)).select("job_id", "id", F.row_number().over(c.Window.partitionBy("job_id").orderBy(c.priority("category"), "position", "id")).alias("place")), f"WITH RECURSIVE {DEDUPE} SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY prio, position, id) AS place FROM d4")
query("d06_contradictions", ["corrections"], lambda k: c.contradictions(k).select("id"), f"WITH t AS (SELECT id, job_id, {KEY} AS o, lower({strip('corrected_text')}) AS r FROM {{corrections}} WHERE corrected_text IS NOT NULL) SELECT DISTINCT a.id FROM t a JOIN t b ON a.job_id = b.job_id AND a.o = b.r AND a.r = b.o AND a.id <> b.id WHERE a.o <> '' AND a.r <> ''")
query("d07_new_feedback", ["corrections", "feedback"], lambda k, f: k.join(f.where("feedback_type = 'false_positive'"), k["id"] == f["correction_id"], "left_anti").select("id"), "SELECT k.id FROM {corrections} k ANTI JOIN (SELECT correction_id FROM {feedback} WHERE feedback_type = 'false_positive') f ON f.correction_id = k.id")

ALL = f"{RULES}, clean AS (SELECT * EXCLUDE (g, o, r, e, d, s, stem, ob, rb, ou, ru, fp_rule) FROM ruled WHERE fp_rule IS NULL), {dedupe_sql('clean')}"
query("a01_live_counts", ["corrections"], lambda k: c.deduplicated(c.filtered(k).select(*READ)).groupBy("job_id", "category").agg(F.count("*").alias("n")), f"WITH RECURSIVE {ALL} SELECT job_id, category, count(*) AS n FROM d4 GROUP BY job_id, category")
query(
    "a09_category_map",
    ["corrections"],
    lambda k: c.deduplicated(c.filtered(k).select(*READ)).groupBy("job_id", "category").agg(F.count("*").alias("n")).groupBy("job_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "category", F.col("n").cast("string")))), ",").alias("by_category"), F.sum("n").alias("total")),
    f"WITH RECURSIVE {ALL} SELECT job_id, string_agg(category || ':' || n, ',' ORDER BY category) AS by_category, sum(n)::BIGINT AS total FROM (SELECT job_id, category, count(*) AS n FROM d4 GROUP BY job_id, category) GROUP BY job_id",
)

# ── replies of a model, whole and broken ───────────────────────────────────

SAID = "replace(replace(original_text, chr(92), ''), '\"', concat(chr(92), '\"'))"
ITEM = f"concat('{{\"original\": \"', {SAID}, '\", \"category\": \"', category, '\", \"page_hint\": ', page_number + 1, '}}')"
MESSAGE = lambda corrections, name="soumettre_corrections_pass1": f"concat('{{\"content\": [{{\"type\": \"text\", \"text\": \"voici [\"}}, {{\"type\": \"tool_use\", \"name\": \"{name}\", \"input\": {{\"corrections\": ', {corrections}, '}}}}], \"stop_reason\": \"tool_use\"}}')"
WHOLE = MESSAGE(f"concat('[', {ITEM}, ', \"texte nu\", {{\"original\": \"second\", \"page_hint\": \" 7 \", \"confidence\": 3}}]')")
MODEL_REPLY = f"""CASE seq % 11 WHEN 0 THEN {WHOLE} WHEN 1 THEN substr({WHOLE}, 1, length({WHOLE}) - 9) WHEN 2 THEN {MESSAGE(ITEM)} WHEN 3 THEN {MESSAGE("'[3, null, [], {\"original\": 5, \"category\": null}, {}]'")}
  WHEN 4 THEN {MESSAGE(f"concat('[', {ITEM}, ']')", "autre_outil")} WHEN 5 THEN NULL WHEN 6 THEN {MESSAGE("'[{\"original\": \"un\", \"page_hint\": 2.9}, {\"original\": \"deux\", \"page_hint\": \"p. 3\"}]'")}
  WHEN 7 THEN concat('{{\"content\": [3, {{\"type\": \"tool_use\", \"name\": \"soumettre_corrections_pass1\"}}, ', substr({WHOLE}, 14)) WHEN 8 THEN {MESSAGE(f"concat('[', {ITEM}, ', {{\"original\": \"caf', chr(92), 'u00e9 ', chr(92), '\"noir', chr(92), '\"\", \"corrected\": {{\"a\": 1}}}}]')")} WHEN 9 THEN '' ELSE '[1, 2' END"""
query(
    "p01_model_replies",
    ["corrections"],
    lambda k: replies.raw_corrections(k.select("id", F.expr(MODEL_REPLY).alias("reply"))).select("id", "original", "corrected", "category", "confidence", "page_hint"),
    f"""WITH r AS (SELECT id, CASE WHEN json_valid(reply) THEN reply::JSON END AS j FROM (SELECT id, {MODEL_REPLY} AS reply FROM {{corrections}})),
      b AS (SELECT id, unnest(json_extract(j, '$.content[*]')) AS b FROM r WHERE j IS NOT NULL),
      e AS (SELECT id, unnest(json_extract(b, '$.input.corrections[*]')) AS e FROM b WHERE json_type(b) = 'OBJECT' AND b->>'$.type' = 'tool_use' AND b->>'$.name' = 'soumettre_corrections_pass1')
      SELECT id, {', '.join(f"CASE WHEN json_type(e, '$.{c}') = 'VARCHAR' THEN e->>'$.{c}' END AS {c}" for c in ('original', 'corrected', 'category', 'confidence'))},
        CASE WHEN json_type(e, '$.page_hint') <> 'VARCHAR' THEN trunc((e->>'$.page_hint')::DOUBLE)::INT WHEN regexp_matches(e->>'$.page_hint', '^\\s*[+-]?[0-9]+\\s*$') THEN trim(e->>'$.page_hint')::INT END AS page_hint FROM e WHERE json_type(e) = 'OBJECT'""",
)
