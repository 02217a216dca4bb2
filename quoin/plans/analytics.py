"""Queries over jobs, corrections, feedback and users."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from quoin.operators import analytics as a
from quoin.plans.corrections import FOLD, listed
from quoin.plans.registry import query

query("a02_feedback_stats", ["feedback"], a.feedback_stats, "SELECT 'category' AS level, category AS value, count(*) AS n FROM {feedback} GROUP BY category UNION ALL SELECT 'doc_type', doc_type, count(*) FROM {feedback} GROUP BY doc_type UNION ALL SELECT 'total', NULL, count(*) FROM {feedback}")
query("a03_top_rejected", ["feedback"], a.top_rejected, "SELECT substr(original_text, 1, 100) AS original_text, category, description, n FROM (SELECT original_text, category, description, count(*) AS n FROM {feedback} GROUP BY ALL ORDER BY n DESC, original_text, category, description LIMIT 20)")
query("a04_by_reason", ["feedback"], a.by_reason, "SELECT coalesce(nullif(reason_code, ''), 'unspecified') AS reason, count(*) AS n FROM {feedback} GROUP BY 1")
query("a05_by_category", ["feedback"], lambda f: a.counted(f, "category"), "SELECT category, count(*) AS n FROM {feedback} GROUP BY category")
REASON = "coalesce(nullif(reason_code, ''), 'non précisé')"
LABEL = "CASE " + REASON + " " + " ".join(f"WHEN '{k}' THEN '{v.replace(chr(39), chr(39) * 2)}'" for k, v in a.REASONS.items()) + f" ELSE {REASON} END"
query("a06_patterns", ["feedback"], a.patterns, f"SELECT doc_type, rank, '- Catégorie ' || category || ' : ' || {LABEL} || ' (' || n || ' signalement' || CASE WHEN n > 1 THEN 's' ELSE '' END || ')' AS line FROM (SELECT *, row_number() OVER (PARTITION BY doc_type ORDER BY n DESC, category, reason_code NULLS FIRST) AS rank FROM (SELECT doc_type, category, reason_code, count(*) AS n FROM {{feedback}} WHERE feedback_type = 'false_positive' GROUP BY ALL HAVING count(*) >= 2)) WHERE rank <= 10")
NEW = "newest AS (SELECT * FROM {jobs} ORDER BY created_at DESC, id LIMIT 200)"
query("a07_dashboard", ["jobs", "feedback", "corrections"], a.dashboard_jobs, f"WITH {NEW} SELECT id, filename, status, coalesce(corrections_count, 0) AS corrections_count, coalesce((SELECT count(*) FROM {{feedback}} f WHERE f.job_id = newest.id), 0) AS false_positives_count, coalesce((SELECT count(*) FROM {{corrections}} c WHERE c.job_id = newest.id AND NOT located), 0) AS unlocated_count, coalesce(doc_type, 'autre') AS doc_type, created_at, actual_cost_usd FROM newest")
query("a07_dashboard_totals", ["jobs", "feedback", "corrections"], a.dashboard_totals, f"WITH {NEW} SELECT (SELECT count(*) FROM newest) AS total_jobs, (SELECT sum(corrections_count)::BIGINT FROM newest) AS total_corrections, (SELECT count(*) FROM {{feedback}}) AS total_false_positives, (SELECT count(*) FROM {{corrections}} WHERE NOT located) AS total_unlocated")
query("a08_debug_summary", ["corrections"], a.debug_summary, "SELECT job_id, category, count(*) AS n, coalesce(string_agg(substr(original_text, 1, 80) || ' -> ' || substr(coalesce(corrected_text, ''), 1, 60), ' | ' ORDER BY rn) FILTER (rn <= 3), '') AS samples FROM (SELECT *, row_number() OVER (PARTITION BY job_id, category ORDER BY seq) AS rn FROM {corrections}) GROUP BY job_id, category")
query("a11_usage_cost", ["jobs"], lambda j: j.groupBy("user_id").agg(F.round(a.usage_cost(j), 6).alias("cost_usd")), "SELECT user_id, round(sum(tokens_in) * 3.0::DOUBLE / 1e6 + sum(tokens_out) * 15.0::DOUBLE / 1e6 + sum(tokens_cached) * 0.3::DOUBLE / 1e6, 6) AS cost_usd FROM {jobs} GROUP BY user_id")
EST = "est AS (SELECT id, preset, pages_count, (2800 * greatest(1, pages_count // 6) + n_chars // 4 + 2000 + least(n_chars // 4, 22000))::BIGINT AS input_tokens, greatest(1, floor(pages_count * 2.5::DOUBLE))::BIGINT AS estimated_corrections FROM {jobs}), est2 AS (SELECT *, floor(estimated_corrections * 80 * 1.3::DOUBLE)::BIGINT AS output_tokens FROM est), est3 AS (SELECT *, round(input_tokens / 1e6 * 3.0::DOUBLE + output_tokens / 1e6 * 15.0::DOUBLE, 4) AS cost FROM est2)"
query("a12_cost_estimate", ["jobs"], a.estimate, f"WITH {EST} SELECT * FROM est3")
query("a13_preset_cost", ["jobs"], lambda j: a.preset_cost(a.estimate(j)).select("id", "preset_cost", "level"), f"WITH {EST}, p AS (SELECT id, round(cost * CASE preset WHEN 'complete' THEN 1.0::DOUBLE WHEN 'quick' THEN 0.65::DOUBLE WHEN 'coherence' THEN 0.3::DOUBLE ELSE 0.05::DOUBLE END, 6) AS preset_cost FROM est3) SELECT *, CASE WHEN preset_cost < 0.5 THEN 'low' WHEN preset_cost < 2 THEN 'medium' ELSE 'high' END AS level FROM p")
CREDIT = "cr AS (SELECT id, CASE WHEN monthly_limit_usd > 0 THEN greatest(0, monthly_limit_usd::DOUBLE - current_month_spend_usd::DOUBLE) END AS remaining_usd, CASE WHEN monthly_limit_usd > 0 THEN least(100, round(current_month_spend_usd::DOUBLE / monthly_limit_usd::DOUBLE * 100)) ELSE 0 END AS pct FROM {users})"
num = lambda u: u.withColumns({c: F.col(c).cast("double") for c in ("monthly_limit_usd", "current_month_spend_usd")})
query("a14_remaining_credit", ["users"], lambda u: a.credit(num(u)).select("id", "remaining_usd", "remaining_eur"), f"WITH {CREDIT} SELECT id, remaining_usd, round(remaining_usd * 0.92::DOUBLE, 2) AS remaining_eur FROM cr")
query("a17_credit_bar", ["users"], lambda u: a.credit(num(u)).select("id", "pct", "colour"), f"WITH {CREDIT} SELECT id, pct, CASE WHEN pct >= 90 THEN 'red' WHEN pct >= 70 THEN 'amber' ELSE 'green' END AS colour FROM cr")
query("a15_rates", ["jobs", "feedback", "corrections"], lambda j, f, c: a.dashboard_totals(j, f, c).select(a.rate(F.col("total_false_positives"), F.col("total_corrections")).alias("fp_rate"), a.rate(F.col("total_unlocated"), F.col("total_corrections")).alias("unlocated_rate")), f"WITH {NEW}, t AS (SELECT sum(corrections_count) AS n FROM newest) SELECT round((SELECT count(*) FROM {{feedback}}) / n * 100, 1) AS fp_rate, round((SELECT count(*) FROM {{corrections}} WHERE NOT located) / n * 100, 1) AS unlocated_rate FROM t")
query("a16_reason_share", ["feedback"], lambda f: a.share_of_total(a.by_reason(f), "reason"), "SELECT reason, n, round(n * 100.0::DOUBLE / sum(n) OVER (), 2) AS share FROM (SELECT coalesce(nullif(reason_code, ''), 'unspecified') AS reason, count(*) AS n FROM {feedback} GROUP BY 1)")
query("a18_pages_with_corrections", ["corrections"], lambda c: c.groupBy("job_id", "page_number").agg(F.array_join(F.array_sort(F.collect_set("category")), "").alias("categories")), "SELECT job_id, page_number, string_agg(DISTINCT category, '' ORDER BY category) AS categories FROM {corrections} GROUP BY ALL")
query("a19_report_sections", ["corrections"], lambda c: a.counted(c, "job_id", "category").withColumn("place", F.row_number().over(Window.partitionBy("job_id").orderBy("category"))), "SELECT job_id, category, count(*) AS n, row_number() OVER (PARTITION BY job_id ORDER BY category) AS place FROM {corrections} GROUP BY job_id, category")

# ── joins ──────────────────────────────────────────────────────────────────

query("j01_rejected_flag", ["corrections", "feedback"], lambda c, f: c.join(f.select(F.col("correction_id").alias("id"), F.lit(True).alias("hit")).distinct(), "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("is_false_positive")), "SELECT k.id, f.correction_id IS NOT NULL AS is_false_positive FROM {corrections} k LEFT JOIN (SELECT DISTINCT correction_id FROM {feedback}) f ON f.correction_id = k.id")
query("j02_fp_counts", ["jobs", "feedback"], lambda j, f: j.join(a.counted(f, "job_id"), F.col("id") == F.col("job_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), "SELECT j.id, count(f.id) AS n FROM {jobs} j LEFT JOIN {feedback} f ON f.job_id = j.id GROUP BY j.id")
query("j03_unlocated_counts", ["jobs", "corrections"], lambda j, c: j.join(a.counted(c.where("NOT located"), "job_id"), F.col("id") == F.col("job_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), "SELECT j.id, count(c.id) AS n FROM {jobs} j LEFT JOIN {corrections} c ON c.job_id = j.id AND NOT located GROUP BY j.id")
query("j05_user_job_count", ["users", "jobs"], lambda u, j: u.join(a.counted(j, "user_id"), F.col("id") == F.col("user_id"), "left").select("id", F.coalesce("n", F.lit(0)).alias("n")), "SELECT u.id, (SELECT count(*) FROM {jobs} j WHERE j.user_id = u.id) AS n FROM {users} u")
query("j06_user_rejections", ["users", "jobs", "feedback"], a.user_jobs, "SELECT u.id, count(DISTINCT j.id) AS jobs, count(f.id) AS rejected FROM {users} u LEFT JOIN {jobs} j ON j.user_id = u.id LEFT JOIN {feedback} f ON f.job_id = j.id GROUP BY u.id")
query("j13_ownership", ["users", "jobs"], lambda u, j: j.select(F.col("id").alias("job_id"), "user_id").join(u.select(F.col("id").alias("user_id"), "role"), "user_id").select("job_id", "role"), "SELECT j.id AS job_id, role FROM {jobs} j JOIN {users} u ON u.id = j.user_id")
query("j14_feedback_reasons", ["corrections", "feedback"], lambda k, f: k.select(F.col("id").alias("correction_id")).join(f.select("correction_id", F.col("id").alias("feedback_id"), F.coalesce("reason_code", F.lit("none")).alias("reason")), "correction_id").groupBy("correction_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("reason")), ",").alias("reasons")), "SELECT k.id AS correction_id, count(*) AS n, string_agg(DISTINCT coalesce(reason_code, 'none'), ',' ORDER BY coalesce(reason_code, 'none')) AS reasons FROM {corrections} k JOIN {feedback} f ON f.correction_id = k.id GROUP BY k.id")

# ── comparison of runs: jobs 2k and 2k + 1 of a pair ───────────────────────

number = lambda c: F.substring(c, 4, 20).cast("long")
paired = lambda rows, c: rows.withColumns({"pair": F.floor(number(c) / 2), "side": number(c) % 2})
RUN = f"""run AS (SELECT *, substr(job_id, 4)::BIGINT // 2 AS pair, substr(job_id, 4)::BIGINT % 2 AS side_no, {FOLD} AS k FROM {{corrections}}),
  won AS (SELECT pair, side_no, category, k, arg_max(id, (page_number, category, seq)) AS id FROM run GROUP BY ALL),
  cmp AS (SELECT coalesce(x.pair, y.pair) AS pair, coalesce(x.category, y.category) AS category, CASE WHEN x.id IS NOT NULL AND y.id IS NOT NULL THEN 'common' WHEN x.id IS NOT NULL THEN 'only_a' ELSE 'only_b' END AS side, coalesce(x.id, y.id) AS id
    FROM (SELECT * FROM won WHERE side_no = 0) x FULL JOIN (SELECT * FROM won WHERE side_no = 1) y ON x.pair = y.pair AND x.category = y.category AND x.k = y.k)"""
compare = lambda c: a.compared(paired(c, "job_id"))
query("c01_compare", ["corrections"], compare, f"WITH {RUN} SELECT * FROM cmp")
query("j04_compare_counts", ["corrections"], lambda c: a.counted(compare(c), "pair", "side"), f"WITH {RUN} SELECT pair, side, count(*) AS n FROM cmp GROUP BY ALL")
STAB = f"{RUN}, st AS (SELECT pair, count(*) AS total, count(*) FILTER (side = 'common') AS common, round(count(*) FILTER (side = 'common') / count(*), 3) AS stability FROM cmp GROUP BY pair)"
query("c02_stability", ["corrections"], lambda c: a.stability(compare(c)).select("pair", "total", "common", "stability"), f"WITH {STAB} SELECT * FROM st")
query("c03_by_category", ["corrections"], lambda c: a.by_category(compare(c)), f"WITH {RUN} SELECT pair, category, count(*) FILTER (side = 'common') AS common, count(*) FILTER (side = 'only_a') AS only_a, count(*) FILTER (side = 'only_b') AS only_b FROM cmp GROUP BY ALL")
query("c04_same_file", ["jobs"], lambda j: a.same_file(paired(j, "id")), r"WITH s AS (SELECT substr(id, 4)::BIGINT // 2 AS pair, substr(id, 4)::BIGINT % 2 AS side, regexp_replace(lower(filename), '\.[^.]+$', '') AS stem FROM {jobs}) SELECT x.pair, x.stem = y.stem AS same_file FROM s x JOIN s y ON x.pair = y.pair AND x.side = 0 AND y.side = 1")
query("c05_verdict", ["corrections"], lambda c: a.stability(compare(c)).select("pair", "verdict", "colour"), f"WITH {STAB} SELECT pair, CASE WHEN round(stability * 100) >= 85 THEN 'Très bonne stabilité' WHEN round(stability * 100) >= 65 THEN 'Stabilité modérée' ELSE 'Instabilité détectée' END AS verdict, CASE WHEN round(stability * 100) >= 80 THEN 'emerald' WHEN round(stability * 100) >= 60 THEN 'amber' ELSE 'red' END AS colour FROM st")
PRESETS = {k: list(v) for k, v in a.PRESET_CATEGORIES.items()}
cats = lambda: F.create_map(*(x for k, v in PRESETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("preset")]
CATS = "CASE preset " + " ".join(f"WHEN '{k}' THEN [{listed(v)}]" for k, v in PRESETS.items()) + " END"
query("c06_passes", ["jobs"], lambda j: j.select("id", F.arrays_overlap(cats(), F.array(*map(F.lit, "ABCD"))).alias("pass1"), F.arrays_overlap(cats(), F.array(*map(F.lit, "EFG"))).alias("pass2"), F.array_contains(cats(), "H").alias("facts")), f"SELECT id, list_has_any({CATS}, ['A', 'B', 'C', 'D']) AS pass1, list_has_any({CATS}, ['E', 'F', 'G']) AS pass2, list_contains({CATS}, 'H') AS facts FROM {{jobs}}")
query(
    "c07_union_of_passes",
    ["corrections"],
    a.pass_outputs,
    "SELECT job_id, stage, count(*) AS n FROM (SELECT job_id, 1 AS stage FROM {corrections} WHERE category IN ('A', 'B', 'C', 'D') UNION ALL SELECT job_id, 2 FROM {corrections} WHERE category IN ('A', 'B', 'C') UNION ALL SELECT job_id, 3 FROM {corrections} WHERE category IN ('E', 'F', 'G') UNION ALL SELECT job_id, 4 FROM {corrections} WHERE category = 'H') GROUP BY ALL",
)

# ── listings ───────────────────────────────────────────────────────────────

query("o01_corrections_listing", ["corrections"], lambda c: c.select("job_id", "id", "category", (F.col("page_number") + 1).alias("page"), F.row_number().over(Window.partitionBy("job_id").orderBy("page_number", "category", "seq")).alias("place")), "SELECT job_id, id, category, page_number + 1 AS page, row_number() OVER (PARTITION BY job_id ORDER BY page_number, category, seq) AS place FROM {corrections}")
query("o02_job_listing", ["jobs"], lambda j: a.newest(j, 50).select("id", "created_at"), "SELECT id, created_at FROM {jobs} ORDER BY created_at DESC, id LIMIT 50")
query("o03_user_history", ["jobs"], lambda j: j.withColumn("place", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("created_at"), "id"))).where("place <= 100").select("user_id", "id", "place"), "SELECT user_id, id, place FROM (SELECT user_id, id, row_number() OVER (PARTITION BY user_id ORDER BY created_at DESC, id) AS place FROM {jobs}) WHERE place <= 100")
query("o04_user_listing", ["users"], lambda u: a.numbered(u.select("id", F.lower(F.trim("email")).alias("email"), "last_reset_at"), "last_reset_at", "id").select("id", "email", "place"), "SELECT id, lower(trim(email)) AS email, row_number() OVER (ORDER BY last_reset_at, id) AS place FROM {users}")
query("o05_result_view", ["corrections", "feedback"], lambda c, f: c.join(f, c["id"] == f["correction_id"], "left_anti").select("id", "category"), "SELECT k.id, k.category FROM {corrections} k ANTI JOIN {feedback} f ON f.correction_id = k.id")
text = lambda needle: F.exists(F.array(*(F.lower(F.coalesce(x, F.lit(""))) for x in ("original_text", "corrected_text", "description", "explanation"))), lambda s: F.contains(s, F.lit(needle)))
query("o06_search", ["corrections"], lambda c: c.where(text("lace")).select("id"), "SELECT id FROM {corrections} WHERE contains(lower(coalesce(original_text, '')), 'lace') OR contains(lower(coalesce(corrected_text, '')), 'lace') OR contains(lower(description), 'lace') OR contains(lower(explanation), 'lace')")
rank = lambda: F.when(F.col("confidence") == "Certain", 0).when(F.col("confidence") == "Probable", 1).when(F.col("confidence") == "À vérifier", 2).otherwise(1)
query("o07_by_confidence", ["corrections"], lambda c: c.select("job_id", "id", F.row_number().over(Window.partitionBy("job_id").orderBy(rank(), "page_number", "seq")).alias("place")), "SELECT job_id, id, row_number() OVER (PARTITION BY job_id ORDER BY CASE confidence WHEN 'Certain' THEN 0 WHEN 'Probable' THEN 1 WHEN 'À vérifier' THEN 2 ELSE 1 END, page_number, seq) AS place FROM {corrections}")
query("o10_export_order", ["feedback"], lambda f: f.select("id", F.row_number().over(Window.partitionBy("job_id").orderBy(F.desc("created_at"), "id")).alias("place")), "SELECT id, row_number() OVER (PARTITION BY job_id ORDER BY created_at DESC, id) AS place FROM {feedback}")
