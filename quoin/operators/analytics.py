"""Dashboards, feedback statistics, run comparison, costs: aggregates over the relational core."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.text import folded, mapped
from quoin.session import cut

# Prices (USD per million tokens), presets and labels.
PRICES = {"tokens_in": 3.0, "tokens_out": 15.0, "tokens_cached": 0.30}
PRESET_SHARE = {"complete": 1.0, "quick": 0.65, "coherence": 0.3, "facts": 0.05}
PRESET_CATEGORIES = {"complete": "ABCDEFGH", "quick": "ABCD", "coherence": "EFG", "facts": "H"}
REASONS = {
    "hallucination_text": "passage inventé par l'IA",
    "already_correct": "texte déjà correct",
    "wrong_correction": "correction erronée proposée",
    "wrong_fact_date": "date ou fait mal évalué",
    "passage_confusion": "confusion entre passages",
    "author_style": "style voulu par l'auteur",
    "faithful_quote": "citation fidèle modifiée",
    "fictional_term": "terme fictif/inventé traité comme faute",
    "wrong_context": "mauvais contexte narratif",
}
EUR = 0.92


def counted(rows: DataFrame, *by: str, name: str = "n") -> DataFrame:
    return rows.groupBy(*by).agg(F.count("*").alias(name))


def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Total, by category and by document type in one pass of grouping sets."""
    sets = feedback.groupingSets([["category"], ["doc_type"], []], "category", "doc_type")
    level = F.when(F.grouping("category") == 0, "category").when(F.grouping("doc_type") == 0, "doc_type").otherwise("total")
    return sets.agg(F.count("*").alias("n"), level.alias("level")).select("level", F.coalesce("category", "doc_type").alias("value"), "n")


def top_rejected(feedback: DataFrame, most: int = 20) -> DataFrame:
    rows = counted(feedback, "original_text", "category", "description")
    return rows.orderBy(F.desc("n"), "original_text", "category", "description").limit(most).withColumn("original_text", F.substring("original_text", 1, 100))


def by_reason(feedback: DataFrame) -> DataFrame:
    return counted(feedback.withColumn("reason", F.coalesce(F.nullif(F.col("reason_code"), F.lit("")), F.lit("unspecified"))), "reason")


def patterns(feedback: DataFrame, most: int = 10) -> DataFrame:
    """For each document type the commonest (category, reason) pairs that were reported twice
    or more, as lines."""
    rows = counted(feedback.where("feedback_type = 'false_positive'"), "doc_type", "category", "reason_code").where("n >= 2")
    order = Window.partitionBy("doc_type").orderBy(F.desc("n"), "category", F.col("reason_code").asc_nulls_first())
    top = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    reason = F.coalesce(F.nullif(F.col("reason_code"), F.lit("")), F.lit("non précisé"))
    line = F.concat(F.lit("- Catégorie "), F.col("category"), F.lit(" : "), F.coalesce(mapped(REASONS, reason), reason), F.lit(" ("), F.col("n").cast("string"), F.lit(" signalement"), F.when(F.col("n") > 1, "s").otherwise(""), F.lit(")"))
    return top.select("doc_type", "rank", line.alias("line"))


def newest(jobs: DataFrame, most: int) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), "id").limit(most)


def dashboard_jobs(jobs: DataFrame, feedback: DataFrame, corrections: DataFrame, most: int = 200) -> DataFrame:
    """The newest jobs with what was rejected and not located. Only the rows of those jobs are
    counted: their ids, ``most`` at most, are broadcast."""
    top = cut(newest(jobs, most))
    ids = F.broadcast(top.select(F.col("id").alias("job_id")))
    rows = top.join(counted(feedback.join(ids, "job_id", "left_semi"), "job_id", name="fp"), F.col("id") == F.col("job_id"), "left").drop("job_id")
    rows = rows.join(counted(corrections.where("NOT located").join(ids, "job_id", "left_semi"), "job_id", name="un"), F.col("id") == F.col("job_id"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    return rows.select("id", "filename", "status", F.coalesce("corrections_count", F.lit(0)).alias("corrections_count"), zero("fp").alias("false_positives_count"), zero("un").alias("unlocated_count"), F.coalesce("doc_type", F.lit("autre")).alias("doc_type"), "created_at", "actual_cost_usd")


def dashboard_totals(jobs: DataFrame, feedback: DataFrame, corrections: DataFrame, most: int = 200) -> DataFrame:
    """Rejections and unlocated rows count over all jobs, corrections over the listed ones."""
    listed = newest(jobs, most).agg(F.count("*").alias("total_jobs"), F.sum("corrections_count").alias("total_corrections"))
    rejected = feedback.agg(F.count("*").alias("total_false_positives"))
    unlocated = corrections.where("NOT located").agg(F.count("*").alias("total_unlocated"))
    return listed.crossJoin(rejected).crossJoin(unlocated)  # one row each


def rate(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, F.round(part / whole * 100, 1)).otherwise(0.0)


def pass_outputs(corrections: DataFrame) -> DataFrame:
    """Rows of each job by the pass that gives them (two of them give A to C): a row is read once and
    counted for every pass of its category."""
    stages = F.array_compact(F.array(*(F.when(F.col("category").isin(list(c)), k) for k, c in enumerate(("ABCD", "ABC", "EFG", "H"), 1))))
    return counted(corrections.select("job_id", F.explode(stages).alias("stage")), "job_id", "stage")


def share_of_total(rows: DataFrame, value: str) -> DataFrame:
    return rows.withColumn("share", F.round(F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy()), 2)).select(value, "n", "share")


def debug_summary(corrections: DataFrame, samples: int = 3) -> DataFrame:
    order = Window.partitionBy("job_id", "category").orderBy("seq")
    rows = corrections.withColumn("_n", F.row_number().over(order))
    sample = F.when(F.col("_n") <= samples, F.struct("_n", F.concat(F.substring("original_text", 1, 80), F.lit(" -> "), F.substring(F.coalesce("corrected_text", F.lit("")), 1, 60)).alias("s")))
    return rows.groupBy("job_id", "category").agg(F.count("*").alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list(sample)), lambda x: x["s"]), " | ").alias("samples"))


def usage_cost(rows: DataFrame) -> Column:
    return sum((F.sum(c) * p / 1e6 for c, p in PRICES.items()), F.lit(0.0))


def estimate(jobs: DataFrame) -> DataFrame:
    """Tokens and cost foreseen for a document, from its pages and characters."""
    tokens = F.floor(F.col("n_chars") / 4)
    rows = jobs.select("id", "preset", "pages_count", tokens.alias("text_tokens"))
    first = 2800 * F.greatest(F.lit(1), F.floor(F.col("pages_count") / 6)) + F.col("text_tokens")
    second = 2000 + F.least("text_tokens", F.lit(22_000))
    rows = rows.withColumns({"input_tokens": (first + second).cast("long"), "estimated_corrections": F.greatest(F.lit(1), F.floor(F.col("pages_count") * 2.5)).cast("long")})
    rows = rows.withColumn("output_tokens", F.floor(F.col("estimated_corrections") * 80 * 1.3).cast("long"))
    return rows.withColumn("cost", F.round(F.col("input_tokens") / 1e6 * 3.0 + F.col("output_tokens") / 1e6 * 15.0, 4)).drop("text_tokens")


def preset_cost(estimates: DataFrame) -> DataFrame:
    share = F.create_map(*(F.lit(x) for p in PRESET_SHARE.items() for x in p))[F.col("preset")]
    rows = estimates.withColumn("preset_cost", F.round(F.col("cost") * share, 6))
    return rows.withColumn("level", F.when(F.col("preset_cost") < 0.5, "low").when(F.col("preset_cost") < 2, "medium").otherwise("high"))


def credit(users: DataFrame) -> DataFrame:
    limit, spent = F.col("monthly_limit_usd"), F.col("current_month_spend_usd")
    left = F.when(limit > 0, F.greatest(F.lit(0.0), limit - spent))
    pct = F.when(limit > 0, F.least(F.lit(100.0), F.round(spent / limit * 100))).otherwise(0.0)
    return users.select("id", left.alias("remaining_usd"), F.round(left * EUR, 2).alias("remaining_eur"), pct.alias("pct"), F.when(pct >= 90, "red").when(pct >= 70, "amber").otherwise("green").alias("colour"))


def user_jobs(users: DataFrame, jobs: DataFrame, feedback: DataFrame) -> DataFrame:
    """Each user's jobs and rejections, users without any included."""
    fp = counted(feedback, "job_id", name="fp")
    each = jobs.join(fp, F.col("id") == F.col("job_id"), "left").groupBy("user_id").agg(F.count("*").alias("jobs"), F.sum(F.coalesce("fp", F.lit(0))).alias("rejected"))
    return users.select("id").join(each, F.col("id") == F.col("user_id"), "left").select("id", F.coalesce("jobs", F.lit(0)).alias("jobs"), F.coalesce("rejected", F.lit(0)).alias("rejected"))


def compared(runs: DataFrame) -> DataFrame:
    """Keys (pair, category, fuzzy text) of both runs of a pair (``side`` 0 and 1) with the row
    that stands for each and where it was found: of a run, the last row by page and category,
    later rows after earlier ones, which a mapping filled in that order is left with. One
    aggregation finds both."""
    order = F.struct("page_number", "category", "seq")
    keyed = runs.withColumn("_key", folded(F.coalesce("original_text", F.lit(""))))
    last = lambda k: F.max_by("id", F.when(F.col("side") == k, order))
    met = keyed.groupBy("pair", "category", "_key").agg(last(0).alias("a"), last(1).alias("b"))
    side = F.when(F.col("a").isNotNull() & F.col("b").isNotNull(), "common").when(F.col("a").isNotNull(), "only_a").otherwise("only_b")
    return met.select("pair", "category", side.alias("side"), F.coalesce("a", "b").alias("id"))


def stability(compare: DataFrame) -> DataFrame:
    rows = compare.groupBy("pair").agg(F.count("*").alias("total"), F.count_if(F.col("side") == "common").alias("common"))
    rows = rows.withColumn("stability", F.coalesce(F.round(F.try_divide("common", "total"), 3), F.lit(1.0)))
    pct = F.round(F.col("stability") * 100)
    verdict = F.when(pct >= 85, "Très bonne stabilité").when(pct >= 65, "Stabilité modérée").otherwise("Instabilité détectée")
    return rows.withColumns({"verdict": verdict, "colour": F.when(pct >= 80, "emerald").when(pct >= 60, "amber").otherwise("red")})


def by_category(compare: DataFrame) -> DataFrame:
    side = lambda s: F.count_if(F.col("side") == s).alias(s)
    return compare.groupBy("pair", "category").agg(side("common"), side("only_a"), side("only_b"))


def same_file(runs: DataFrame) -> DataFrame:
    """For each pair of jobs whether both runs were over files of one name."""
    name = stem(F.col("filename"))
    return runs.groupBy("pair").agg((F.count_if(F.col("side") == 0) > 0).alias("a"), (F.count_if(F.col("side") == 1) > 0).alias("b"), (F.min(name) == F.max(name)).alias("same")).where("a AND b").select("pair", F.coalesce("same", F.lit(False)).alias("same_file"))


def numbered(rows: DataFrame, *order: Column | str) -> DataFrame:
    """``rows`` with ``place``, their number in the whole order, from 1. Ranges of the order are
    dealt to tasks; only the ranges' sizes meet in one task."""
    dealt = cut(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = dealt.groupBy("_part").agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    offsets = sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return dealt.withColumn("_own", own).join(offsets, "_part").withColumn("place", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def stem(filename: Column) -> Column:
    return F.regexp_replace(F.lower(filename), r"\.[^.]+$", "")
