"""Queries over states, quotas, progress, places and reports."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quoin.operators import geometry as g
from quoin.operators import lifecycle as c
from quoin.operators import report as r
from quoin.plans.corrections import listed
from quoin.plans.mining import strip
from quoin.plans.registry import query
from quoin.sources import files

# ── lifecycle ──────────────────────────────────────────────────────────────

query("l01_latest_state", ["states"], c.latest, "SELECT job_id, arg_max(status, (ts, event_id)) AS status, max(ts) AS updated_at FROM {states} GROUP BY job_id")
query("l02_orphan_watchdog", ["jobs"], lambda j: c.after_restart(j).select("id", "status"), f"SELECT id, CASE WHEN status IN ({listed(c.TRANSIENT)}) THEN 'error' ELSE status END AS status FROM {{jobs}}")
now = lambda: F.lit("1998-08-10").cast("timestamp")
query("l03_month_rollover", ["users"], lambda u: c.rolled_over(u, now()).select("id", F.col("spend").cast("double").alias("spend")), "SELECT id, CASE WHEN date_trunc('month', last_reset_at) = TIMESTAMP '1998-08-01' THEN current_month_spend_usd::DOUBLE ELSE 0 END AS spend FROM {users}")
query("l03_monthly_spend", ["jobs"], c.monthly_spend, "SELECT user_id, strftime(created_at, '%Y-%m') AS month, round(sum(actual_cost_usd), 6) AS spend FROM {jobs} GROUP BY ALL")
query("l04_quota_gate", ["users"], lambda u: u.select("id", c.blocked(F.col("monthly_limit_usd"), F.col("current_month_spend_usd")).alias("blocked")), "SELECT id, monthly_limit_usd > 0 AND current_month_spend_usd >= monthly_limit_usd AS blocked FROM {users}")
query("l05_reset_errored", ["jobs", "corrections"], lambda j, k: k.join(j.where("status = 'error'").select(F.col("id").alias("job_id")), "job_id", "left_anti").select("id"), "SELECT id FROM {corrections} WHERE job_id NOT IN (SELECT id FROM {jobs} WHERE status = 'error')")
STEPS = """st AS (SELECT id, unnest([0, 1, 2, 3]) AS step_no, unnest(['extract', 'analyse', 'factcheck', 'annotate']) AS step, greatest(1, pages_count) / 50::DOUBLE AS ratio, CASE WHEN pages_count > 100 THEN (pages_count - 100) // 60 * 25 ELSE 0 END AS extra FROM {jobs}),
  sec AS (SELECT id, step_no, step, CASE step_no WHEN 0 THEN 3 * ratio WHEN 1 THEN 120 * ratio + extra WHEN 2 THEN 30 * ratio ELSE 8 * ratio END AS seconds FROM st),
  rem AS (SELECT *, sum(seconds) OVER (PARTITION BY id ORDER BY step_no ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_ FROM sec)"""
LEFT = lambda x: f"CASE WHEN {x} < 5 THEN 'presque terminé…' WHEN {x} < 60 THEN '~' || floor({x})::INT || 's' ELSE '~' || floor({x} / 60)::INT || ' min' END"
query("l06_time_estimate", ["jobs"], c.remaining, f"WITH {STEPS} SELECT id, step_no, step, seconds, round(left_, 6) AS remaining, {LEFT('left_')} AS label FROM rem")
RUN = """run_ AS (SELECT job_id, event_id, row_number() OVER (PARTITION BY job_id ORDER BY ts, event_id) AS done, count(*) OVER (PARTITION BY job_id) AS total,
  epoch(date_trunc('second', ts))::BIGINT - epoch(date_trunc('second', min(ts) OVER (PARTITION BY job_id)))::BIGINT AS elapsed FROM {states})"""
query("l07_duration_format", ["states"], lambda s: c.running(s).select("event_id", c.duration(F.col("elapsed")).alias("label")), f"WITH {RUN} SELECT event_id, {LEFT('elapsed')} AS label FROM run_")
progress = lambda: F.floor(F.col("done") * 100.0 / F.col("total"))
PROGRESS = "floor(done * 100.0::DOUBLE / total)"
query("l08_progress_step", ["states"], lambda s: c.running(s).select("event_id", c.active_step(progress()).alias("step"), F.round(c.extrapolated(progress(), F.col("elapsed")), 3).alias("remaining")), f"WITH {RUN} SELECT event_id, CASE WHEN {PROGRESS} >= 88 THEN 3 WHEN {PROGRESS} >= 75 THEN 2 WHEN {PROGRESS} >= 15 THEN 1 ELSE 0 END AS step, CASE WHEN {PROGRESS} > 5 AND elapsed > 5 THEN round((100 - {PROGRESS}) / ({PROGRESS} / elapsed), 3) END AS remaining FROM run_")
query("l09_progress_mapping", ["states"], lambda s: c.running(s).select("event_id", c.pass_progress(F.col("done"), F.col("total")).alias("pass_pct"), c.fact_progress(F.col("done"), F.col("total")).alias("fact_pct")), f"WITH {RUN} SELECT event_id, 12 + floor(least(done / total::DOUBLE, 1.0) * 0.65::DOUBLE * 66)::INT AS pass_pct, 78 + floor(done / total::DOUBLE * 10)::INT AS fact_pct FROM run_")
query("l10_timeout", ["jobs"], lambda j: j.select("id", c.timeout(F.col("pages_count"), F.col("preset").isin("complete", "quick"), F.col("preset").isin("complete", "coherence")).alias("seconds")), "SELECT id, greatest(180, CASE WHEN preset IN ('complete', 'quick') THEN ceil(ceil(pages_count / CASE WHEN pages_count <= 30 THEN 3 WHEN pages_count <= 100 THEN 4 ELSE 5 END) / CASE WHEN pages_count > 80 THEN 2 ELSE 4 END) * 40 + 60 + CASE WHEN pages_count >= 8 THEN 60 ELSE 0 END ELSE 0 END + CASE WHEN preset IN ('complete', 'coherence') THEN 90 ELSE 0 END + 120)::BIGINT AS seconds FROM {jobs}")
query("l11_rate_limit", ["events"], c.per_minute, "SELECT user_id, date_trunc('minute', ts) AS minute, count(*) AS n, greatest(0, count(*) - 10) AS refused_upload, greatest(0, count(*) - 20) AS refused_confirm FROM {events} GROUP BY user_id, date_trunc('minute', ts)")
query("l12_toggles", ["events"], c.toggled, "SELECT user_id, event_type, count(*) % 2 = 1 AS on FROM {events} GROUP BY user_id, event_type".replace(" AS on ", ' AS "on" '))
query("l13_user_validation", ["users"], c.user_problems, "SELECT id, lower(trim(email)) AS email, CASE WHEN NOT contains(email, '@') THEN 'email' WHEN count(*) OVER (PARTITION BY lower(trim(email))) > 1 THEN 'duplicate' WHEN role NOT IN ('user', 'admin') THEN 'role' WHEN monthly_limit_usd < 0 THEN 'limit' END AS problem FROM {users}")
query("l14_cancel", ["jobs"], lambda j: j.where("status <> 'awaiting_confirmation'").select("id"), "SELECT id FROM {jobs} WHERE status <> 'awaiting_confirmation'")

# ── places ─────────────────────────────────────────────────────────────────


def norm(x: str) -> str:
    for src, dst in g.PAIRS:
        x = f"replace({x}, '{src}', '{dst.replace(chr(39), chr(39) * 2)}')"
    return strip(f"regexp_replace({x}, ' {{2,}}', ' ', 'g')")


PARTS = lambda x: f"list_transform(list_filter(regexp_split_to_array({x}, '[\\s\\x{{A0}}\\x{{202F}}]+'), lambda w: w <> ''), lambda w: lower({norm('w')}))"
PLACED = r"""raww AS (SELECT doc_id, page_num, list_filter(regexp_split_to_array(text, '[\s\x{A0}\x{202F}]+'), lambda w: w <> '') AS ws FROM {manuscript}),
  placed AS (SELECT doc_id, page_num, i::INT AS word_idx, ws[i + 1] AS word, (i % 10) * 50.0::DOUBLE AS x0, floor(i / 10) * 14.5::DOUBLE AS y0, (i % 10) * 50.0::DOUBLE + 45 AS x1, floor(i / 10) * 14.5::DOUBLE + 12 AS y1 FROM (SELECT *, unnest(range(len(ws))) AS i FROM raww))"""
FOUND = f"""wtext AS (SELECT doc_id, page_num AS found_page, {PARTS('text')} AS ws FROM {{manuscript}}), wstart AS (SELECT *, unnest(range(len(ws))) AS i FROM wtext),
  ask AS (SELECT *, {PARTS('original_text')} AS ph FROM {{requests}}),
  met AS (SELECT request_id, a.doc_id, page_num, found_page, min(i)::INT AS word_idx, any_value(len(ph))::INT AS n FROM ask a JOIN wstart s ON s.doc_id = a.doc_id AND s.ws[i + 1] = ph[1] AND s.ws[i + 1 : i + len(ph)] = ph GROUP BY ALL)"""


def placed_sql(band: int) -> str:
    return f"{FOUND}, loc AS (SELECT request_id, doc_id, found_page, word_idx, n, step FROM (SELECT *, row_number() OVER (PARTITION BY request_id ORDER BY step, found_page) AS rn FROM (SELECT *, CASE WHEN found_page = page_num THEN 0 WHEN abs(found_page - page_num) <= {band} THEN 1 ELSE 2 END AS step FROM met)) WHERE rn = 1)"


query("g01_normalise", ["manuscript"], lambda p: p.select("doc_id", "page_num", g.normalised("text").alias("text")), f"SELECT doc_id, page_num, {norm('text')} AS text FROM {{manuscript}}")
query("g02_phrase_match", ["requests", "manuscript"], g.matches, f"WITH {FOUND} SELECT * FROM met")
query("g03_line_rectangles", ["requests", "manuscript"], lambda q, p: g.rectangles(g.located(q, p), g.placed_words(p)), f"WITH {placed_sql(4)}, {PLACED}, hit AS (SELECT request_id, doc_id, found_page AS page_num, unnest(range(word_idx, word_idx + n))::INT AS word_idx FROM loc) SELECT request_id, h.page_num, round_even(y0, 0) AS line, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM hit h JOIN placed USING (doc_id, page_num, word_idx) GROUP BY ALL")
query("g04_single_words", ["requests", "manuscript"], lambda q, p: g.matches(q.where(~F.contains(F.trim("original_text"), F.lit(" "))), p), f"WITH {FOUND} SELECT * FROM met WHERE n = 1")
LOWER_IN = lambda hay, needle: f"contains(lower({hay}), lower({needle}))"
query(
    "g05_strategies",
    ["requests", "manuscript"],
    g.strategies,
    f"SELECT request_id, CASE WHEN {LOWER_IN('p.text', strip('original_text'))} THEN 1 WHEN {LOWER_IN(norm('p.text'), norm(strip('original_text')))} THEN 2 WHEN contains(' ' || array_to_string({PARTS('p.text')}, ' ') || ' ', ' ' || array_to_string({PARTS('original_text')}, ' ') || ' ') THEN 3 WHEN length({strip('original_text')}) > 30 AND {LOWER_IN('p.text', f'rtrim(substr({strip(chr(111) + chr(114) + chr(105) + chr(103) + chr(105) + chr(110) + chr(97) + chr(108) + chr(95) + chr(116) + chr(101) + chr(120) + chr(116))}, 1, 30))')} THEN 4 END AS strategy FROM {{requests}} q LEFT JOIN {{manuscript}} p USING (doc_id, page_num)",
)
query("g06_page_fallback", ["requests", "manuscript"], g.located, f"WITH {placed_sql(4)} SELECT * FROM loc")
query("g07_page_fallback_wide", ["requests", "manuscript"], lambda q, p: g.located(q, p, g.WIDE_BAND), f"WITH {placed_sql(5)} SELECT * FROM loc")
STATS = f"{placed_sql(5)}, stat AS (SELECT category, count(*) AS asked, count(l.request_id) AS annotated FROM {{requests}} q LEFT JOIN loc l USING (request_id) GROUP BY category)"
query("g08_annotation_stats", ["requests", "manuscript"], lambda q, p: g.annotation_stats(q, g.located(q, p, 5)).drop("alert"), f"WITH {STATS} SELECT *, asked - annotated AS failed, round(1 - annotated / asked, 3) AS failure_rate FROM stat")
query("g09_failure_alert", ["requests", "manuscript"], lambda q, p: g.annotation_stats(q, g.located(q, p, 5)).select("category", "alert"), f"WITH {STATS} SELECT category, 1 - annotated / asked > 0.15 AS alert FROM stat")
split = lambda k: k.withColumn("place", F.row_number().over(Window.partitionBy("job_id", "located").orderBy("page_number", "seq"))).where(F.col("place") <= F.when(F.col("located"), 150).otherwise(100)).select("id", "located")
query("g10_located_split", ["corrections"], split, "SELECT id, located FROM (SELECT *, row_number() OVER (PARTITION BY job_id, located ORDER BY page_number, seq) AS place FROM {corrections}) WHERE place <= CASE WHEN located THEN 150 ELSE 100 END")
query("g11_page_overlay", ["corrections", "feedback"], lambda k, f: k.where("located").join(f, k["id"] == f["correction_id"], "left_anti").select("id", "page_number", "x0", "y0"), "SELECT k.id, k.page_number, k.x0, k.y0 FROM {corrections} k ANTI JOIN {feedback} f ON f.correction_id = k.id WHERE k.located")
query("j12_band_join", ["requests", "manuscript"], lambda q, p: g.near_matches(q, p).select("request_id", "found_page"), f"WITH {FOUND} SELECT request_id, found_page FROM met WHERE abs(found_page - page_num) BETWEEN 1 AND 4")
query(
    "s02_font_filter",
    ["spans"],
    g.without_large_fonts,
    r"WITH l AS (SELECT doc_id, page_num, line, coalesce(string_agg(text, '' ORDER BY span, text) FILTER (size <= 36), '') AS text, coalesce(bool_or(size <= 36) FILTER (regexp_replace(text, '\s', '', 'g') <> ''), false) AS small FROM {spans} GROUP BY ALL) SELECT doc_id, page_num, string_agg(text, chr(10) ORDER BY line, text) AS text FROM l WHERE small AND regexp_replace(text, '\s', '', 'g') <> '' GROUP BY ALL",
)

# ── reports and exports ────────────────────────────────────────────────────

UPPER = "CASE category " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in r.CATEGORY_UPPER.items()) + " END"
FORM = "CASE WHEN coalesce(corrected_text, '') <> '' THEN '« ' || corrected_text || ' »' ELSE 'à confirmer' END"
SHOWN = "CASE WHEN coalesce(corrected_text, '') <> '' THEN '« ' || corrected_text || ' »' ELSE '—' END"
NL = "chr(10)"
query("r01_comment_simple", ["requests"], lambda q: q.select("request_id", r.comment("simple").alias("comment")), f"SELECT request_id, CASE WHEN category = 'H' THEN '⚠️ VÉRIFICATION SUGGÉRÉE' || {NL} || description || {NL} || 'Forme possible : ' || {FORM} ELSE {UPPER} || ' → ' || description || {NL} || 'Correction : ' || {SHOWN} END AS comment FROM {{requests}}")
query(
    "r01_comment_detailed",
    ["requests"],
    lambda q: q.select("request_id", r.comment().alias("comment")),
    f"""SELECT request_id, CASE WHEN category = 'H' THEN '⚠️ VÉRIFICATION SUGGÉRÉE PAR L''IA' || {NL} || {NL} || 'Motif : ' || description || {NL} || {NL} || 'Explication : ' || explanation || {NL} || {NL} || 'Forme possible : ' || {FORM} || {NL} || {NL} || '→ À valider par l''éditeur ou l''auteur avant toute correction.' || CASE WHEN source <> '' THEN {NL} || {NL} || 'Source consultée : ' || source ELSE '' END
      ELSE {UPPER} || ' → ' || description || {NL} || CASE confidence WHEN 'Certain' THEN '✅' WHEN 'Probable' THEN '🔶' ELSE '⚠️' END || ' ' || confidence || {NL} || {NL} || 'Explication : ' || explanation || {NL} || {NL} || 'Correction proposée : ' || {SHOWN} || CASE WHEN source <> '' THEN {NL} || {NL} || source ELSE '' END END AS comment FROM {{requests}}""",
)


def safe(x: str, most: int = 35) -> str:
    x = f"regexp_replace({x}, '[\\n\\r]', ' ', 'g')"
    for src, dst in r.REPLACEMENTS:
        x = f"replace({x}, '{src}', '{dst.replace(chr(39), chr(39) * 2)}')"
    x = strip(f"regexp_replace(regexp_replace(translate({x}, '{r.ACCENTS[0]}', '{r.ACCENTS[1]}'), '[^\\x00-\\x7F]', '?', 'g'), ' {{2,}}', ' ', 'g')")
    return f"CASE WHEN length({x}) > {most} THEN substr({x}, 1, {most}) || '...' ELSE {x} END"


query("r02_ascii_safe", ["manuscript"], lambda p: p.select("doc_id", "page_num", r.ascii_safe(F.col("text")).alias("text")), f"SELECT doc_id, page_num, {safe('text')} AS text FROM {{manuscript}}")
query("r03_output_name", ["jobs"], lambda j: j.select("id", r.output_name(F.col("filename"), F.col("preset")).alias("name")), r"SELECT id, CASE WHEN s = '' THEN 'document' ELSE s END || '_' || CASE preset WHEN 'complete' THEN 'correction-complete' WHEN 'quick' THEN 'correction-rapide' WHEN 'coherence' THEN 'coherence-globale' WHEN 'facts' THEN 'verification-faits' ELSE 'correction' END || '.pdf' AS name FROM (SELECT *, regexp_replace(regexp_replace(filename, '\.[^.]+$', ''), '[^A-Za-z0-9._-]', '_', 'g') AS s FROM {jobs})")
query("r04_metadata_block", ["customer"], lambda k: k.select("c_custkey", r.metadata_block(F.when(F.col("c_custkey") % 2 == 0, F.col("c_name")).otherwise(""), F.when(F.col("c_custkey") % 3 == 0, F.col("c_mktsegment")).otherwise("")).alias("block")), "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 OR c_custkey % 3 = 0 THEN '**MÉTADONNÉES (exclusions absolues) :**' || chr(10) || concat_ws(chr(10), CASE WHEN c_custkey % 2 = 0 THEN '- Auteur : ' || c_name || ' — NE JAMAIS signaler comme faute' END, CASE WHEN c_custkey % 3 = 0 THEN '- Titre de l''œuvre : ' || c_mktsegment || ' — NE JAMAIS signaler comme faute ou erreur grammaticale' END) END AS block FROM {customer}")
query("r05_count_line", ["jobs"], lambda j: j.select("id", r.count_line(F.col("annotated_count")).alias("line")), "SELECT id, annotated_count || ' correction' || CASE WHEN annotated_count > 1 THEN 's' ELSE '' END || ' annotée' || CASE WHEN annotated_count > 1 THEN 's' ELSE '' END AS line FROM {jobs}")
query("r06_italic_segments", ["raw"], lambda q: q.select("id", F.array_join(r.italics("original"), "|").alias("italics"), F.regexp_replace("original", r"\*[^*]+\*", "|").alias("plain")), r"SELECT id, array_to_string(regexp_extract_all(original, '\*([^*]+)\*', 1), '|') AS italics, regexp_replace(original, '\*[^*]+\*', '|', 'g') AS plain FROM {raw}")
query("p16_italic_strip", ["raw"], lambda q: q.select("id", r.without_italics("original").alias("original")), r"SELECT id, regexp_replace(original, '\*([^*]+)\*', '\1', 'g') AS original FROM {raw}")
query("s05_preview_page", ["corrections", "jobs"], lambda k, j: k.select("job_id", "page_number").distinct().join(j.select(F.col("id").alias("job_id"), "pages_count", "annotated_count"), "job_id").select("job_id", "page_number", r.shown_page(F.col("page_number"), F.col("pages_count"), F.col("annotated_count") > 0).alias("page")), "SELECT job_id, page_number, greatest(0, least(page_number, pages_count - CASE WHEN annotated_count > 0 THEN 2 ELSE 1 END)) AS page FROM (SELECT DISTINCT job_id, page_number FROM {corrections}) JOIN {jobs} ON id = job_id")
query("s08_csv_lines", ["feedback"], lambda f: files.csv_lines(f.select("id", "category", "reason_code", "comment")), "SELECT concat_ws(',', id, category, coalesce(reason_code, ''), coalesce(comment, '')) AS line FROM {feedback}")
query("s09_json_lines", ["feedback"], lambda f: f.select(F.to_json(F.struct("id", "category", "original_text")).alias("line")), "SELECT to_json({'id': id, 'category': category, 'original_text': original_text})::VARCHAR AS line FROM {feedback}")
query("s10_upload_admission", ["pages"], lambda p: p.select("page_id", r.admitted(F.col("url"), F.substring("html", 1, 8), F.octet_length("html")).alias("refused")), "SELECT page_id, CASE WHEN NOT ends_with(lower(url), '.pdf') THEN 'extension' WHEN NOT starts_with(html, '%PDF') THEN 'magic' WHEN octet_length(encode(html)) > 52428800 THEN 'size' END AS refused FROM {pages}")
# uploads of every kind: names, first bytes and sizes that each rule takes or refuses
NAMED, HEAD, SIZE = "CASE page_id % 3 WHEN 0 THEN concat('ms ', page_id, '.pdf') WHEN 1 THEN concat('MS', page_id, '.PDF') ELSE url END", "CASE WHEN page_id % 4 = 0 THEN substr(html, 1, 8) ELSE '%PDF-1.7' END", "{size} * CASE WHEN page_id % 5 = 0 THEN 100000 ELSE 1 END"
query("s10_upload_cases", ["pages"], lambda p: p.select("page_id", r.admitted(F.expr(NAMED), F.expr(HEAD), F.expr(SIZE.format(size="octet_length(html)").replace("100000", "100000L"))).alias("refused")), f"SELECT page_id, CASE WHEN NOT ends_with(lower(n), '.pdf') THEN 'extension' WHEN NOT starts_with(h, '%PDF') THEN 'magic' WHEN s > 52428800 THEN 'size' END AS refused FROM (SELECT page_id, {NAMED} AS n, {HEAD} AS h, {SIZE.format(size='octet_length(encode(html))')} AS s FROM {{pages}})")
query("s12_schema_evolution", ["jobs"], lambda j: files.with_missing_columns(j.where("user_id % 2 = 0").select("id", "status"), j.where("user_id % 2 = 1").select("id", "status", "preset", "annotated_count"), {"preset": "complete", "annotated_count": 0}), "SELECT id, status, 'complete' AS preset, 0 AS annotated_count FROM {jobs} WHERE user_id % 2 = 0 UNION ALL SELECT id, status, preset, annotated_count FROM {jobs} WHERE user_id % 2 = 1")
query("s13_clipboard", ["corrections"], lambda k: k.select("id", r.clipboard().alias("text")), f"SELECT id, concat_ws({NL}, 'p.' || (page_number + 1) || ' — ' || category || ' → ' || description, nullif(explanation, ''), CASE WHEN coalesce(corrected_text, '') <> '' THEN 'Correction : « ' || original_text || ' » → « ' || corrected_text || ' »' ELSE 'Texte : « ' || original_text || ' »' END) AS text FROM {{corrections}}")
query("o08_summary_rows", ["corrections"], lambda k: k.select("job_id", "id", r.ascii_safe(F.col("original_text")).alias("shown"), F.row_number().over(Window.partitionBy("job_id").orderBy("category", "page_number", "seq")).alias("place")), f"SELECT job_id, id, {safe('original_text')} AS shown, row_number() OVER (PARTITION BY job_id ORDER BY category, page_number, seq) AS place FROM {{corrections}}")
query("o09_report_rows", ["corrections"], lambda k: k.select("job_id", "id", F.when(F.length("explanation") > 200, F.concat(F.substring("explanation", 1, 200), F.lit("…"))).otherwise(F.col("explanation")).alias("explanation"), F.row_number().over(Window.partitionBy("job_id", "category").orderBy("page_number", "seq")).alias("place")), "SELECT job_id, id, CASE WHEN length(explanation) > 200 THEN substr(explanation, 1, 200) || '…' ELSE explanation END AS explanation, row_number() OVER (PARTITION BY job_id, category ORDER BY page_number, seq) AS place FROM {corrections}")
