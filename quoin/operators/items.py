"""Facts to be checked, and the rules of the two external checkers (typography, search).

An items frame has doc_id, seq, original_text, context, page_num and item_type.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.text import MARKED, UNMARKED, cut, has_any, strip
from quoin.operators import mining as m
from quoin.sources.tables import staged

# Types, labels, identifiers and word lists of the checkers.
ITEM_TYPES = ["date", "proper_noun", "title"]
TYPE_LABELS = {"date": "Date historique", "proper_noun": "Nom propre", "title": "Titre d'œuvre"}
DESCRIPTIONS = {"date": "Vérification suggérée : date historique", "proper_noun": "Vérification suggérée : orthographe du nom propre", "title": "Vérification suggérée : titre d'œuvre"}
LETTER = "[a-zA-ZÀ-ÿ]"
TYPOGRAPHY_RULES = [
    "GUILLEMETS", "GUILLEMETS_USAGE", "GUILLEMETS_SPACE", "UNPAIRED_BRACKETS", "APOSTROPHE_TYPOGRAPHIQUE", "APOSTROPHE_INCORRECTE",
    "ESPACE_AVANT_DOUBLE_PONCTUATION", "FRENCH_WHITESPACE", "NBSP_AVANT_DOUBLE_PONCTUATION", "ESPACE_INSECABLE", "POINTS_SUSPENSION", "TRIPLE_DOTS",
    "DOUBLE_PUNCTUATION", "WHITESPACE_RULE", "WHITESPACE_BEFORE_PUNCTUATION", "TIRET_CADRANT", "TIRET_DEMI_CADRANT", "POINT",
    "PONCTUATION_FINALE",
]
TYPOGRAPHY_CATEGORIES = ["TYPOGRAPHY", "PUNCTUATION", "WHITESPACE", "FORMATTING", "TYPO", "CAT_TYPOGRAPHIE", "PONCTUATION_TYPOGRAPHIQUE"]
TYPOGRAPHY_WORDS = ["GUILLEMET", "APOSTROPHE", "ESPACE", "NBSP", "TIRET", "PONCTUATION", "QUOTE", "WHITESPACE", "SUSPENSION"]
SKIPPED_RULES = ["UPPERCASE_SENTENCE_START", "SENTENCE_WHITESPACE", "MORFOLOGIK_RULE_FR", "FR_SPELLING_RULE"]
SKIPPED_MESSAGES = ["is a foreign word", "mot étranger"]
SENTENCE_END_RULES = ["POINT", "PONCTUATION_FINALE", "UNPAIRED_BRACKETS", "UPPERCASE_SENTENCE_START"]
VERB_MARKS = [" est ", " sont ", " était ", " avait ", " ont ", " a ", " il ", " elle "]
PUNCTUATION = ".-–—_·•… "
MATCH_SHARE = 0.55
FR_MONTHS = "janvier|février|mars|avril|mai|juin|juillet|août|septembre|octobre|novembre|décembre"


def valid(text: Column) -> Column:
    t = strip(text)
    return (F.length(t) >= 4) & ~t.rlike(r"^\d+$") & t.rlike(LETTER)


def valid_for_search(text: Column) -> Column:
    return valid(text) & ~strip(text).rlike(r"^[A-Z0-9.\-]{1,6}$")


def known_type(item_type: Column) -> Column:
    return F.when(item_type.isin(ITEM_TYPES), item_type).otherwise("proper_noun")


def first_by(rows: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_n = 1").drop("_n")


def hints_clean(raw: DataFrame) -> DataFrame:
    """Fact hints: trimmed, three characters or more, known types, context and page filled in."""
    text = strip(F.coalesce("original", F.lit("")))
    rows = raw.withColumn("text", text).where(F.length("text") >= 3)
    return rows.select("id", "job_id", "seq", "text", known_type(F.col("item_type")).alias("item_type"), F.substring(F.coalesce("description", "text"), 1, 300).alias("context"), F.coalesce("page_hint", F.col("page_number") + 1).alias("page_hint"))


def hint_items(hints: DataFrame, most: int = 50) -> DataFrame:
    """Items from a job's first ``most`` hints: the cut comes before blanks and repeats go."""
    head = hints.withColumn("_r", F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))).where(F.col("_r") <= most)
    rows = first_by(head.withColumn("text", strip("text")).where("text <> ''"), ["job_id", "text"], ["seq"])
    return rows.select("job_id", "seq", F.col("text").alias("original_text"), F.substring(F.coalesce(F.nullif(F.col("context"), F.lit("")), F.col("text")), 1, 300).alias("context"), F.greatest(F.lit(0), F.col("page_hint") - 1).alias("page_num"), known_type(F.col("item_type")).alias("item_type"))


def date_items(pages: DataFrame, most: int = 20) -> DataFrame:
    head = m.first_dates(pages).where(F.col("seq") <= most)
    rows = first_by(head.where("date_text <> ''"), ["doc_id", "date_text"], ["seq"])
    return rows.select("doc_id", "seq", F.col("date_text").alias("original_text"), F.substring("context", 1, 300).alias("context"), "page_num", F.lit("date").alias("item_type"))


def merged_items(hints: DataFrame, dates: DataFrame) -> DataFrame:
    """All hints, and the dates that no hint has."""
    key = lambda df: df.select("doc_id", F.lower("original_text").alias("_k"))
    fresh = dates.withColumn("_k", F.lower("original_text")).join(key(hints).distinct(), ["doc_id", "_k"], "left_anti").drop("_k")
    return hints.unionByName(fresh)


#: Items of each kind that are taken of a document: dates, names, titles.
MOST_OF = {1: 20, 2: 15, 3: 10}
STAGE_TYPES = {1: "date", 2: "proper_noun", 3: "title"}


def fact_only_items(pages: DataFrame, most: int = 40) -> DataFrame:
    """Items without any detector: 20 dates, then 15 names, then 10 titles, each text once. Pages are
    mined for all three at once and dealt by document once; names then look for their first page."""
    stage = F.col("stage")
    found = m.mined(pages).repartition("doc_id").where(F.when(stage == 2, m.valid_name(F.col("text"))).when(stage == 3, F.size(m.words("text")) >= 2).otherwise(True))
    place = ["page_num", "kind", "nth"]
    again = F.row_number().over(Window.partitionBy("doc_id", "stage", "text").orderBy(*place))
    once = found.withColumn("_again", again).where((stage == 1) | (F.col("_again") == 1))
    # names go by code point, dates and titles by place
    ranked = once.withColumn("_nth", F.row_number().over(Window.partitionBy("doc_id", "stage").orderBy(F.when(stage == 2, F.col("text")), *place)))
    taken = ranked.where(F.col("_nth") <= F.create_map(*(F.lit(x) for p in MOST_OF.items() for x in p))[stage]).where("text <> ''")
    first = Window.partitionBy("doc_id", "text").orderBy("stage", "_nth")
    unique = taken.withColumn("_first", F.row_number().over(first)).where("_first = 1")
    # written once: names look for their pages beside it, and pages are mined no second time for that
    listed = staged(unique.withColumn("seq", F.row_number().over(Window.partitionBy("doc_id").orderBy("stage", "_nth"))).where(F.col("seq") <= most).select("doc_id", "seq", "stage", "text", "context", "page_num"))
    # the first page that has a name as a whole, which the pattern need not have found there
    asked = listed.where(stage == 2).groupBy("doc_id").agg(F.collect_list(F.struct("seq", "text")).alias("names"))
    met = pages.select("doc_id", "page_num", F.col("text").alias("_page")).join(asked, "doc_id")
    at = met.select("doc_id", "page_num", F.explode(F.filter("names", lambda x: F.contains(F.col("_page"), x["text"]))).alias("x")).groupBy("doc_id", F.col("x.seq").alias("seq")).agg(F.min("page_num").alias("_found"))
    rows = listed.join(at, ["doc_id", "seq"], "left")
    item_type = F.create_map(*(F.lit(x) for p in STAGE_TYPES.items() for x in p))[stage]
    return rows.select("doc_id", "text", "context", F.when(stage == 2, F.coalesce("_found", F.lit(0))).otherwise(F.col("page_num")).alias("page_num"), item_type.alias("item_type"), "seq")


def prompt(items: DataFrame) -> DataFrame:
    """The numbered list of each document's items."""
    label = F.coalesce(F.create_map(*(F.lit(x) for p in TYPE_LABELS.items() for x in p))[F.col("item_type")], F.lit("Élément"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("seq"))
    line = F.concat(F.lit("\n"), F.col("nth").cast("string"), F.lit(". ["), label, F.lit("] « "), F.col("text"), F.lit(" » (page "), (F.col("page_num") + 1).cast("string"), F.lit(")"))
    more = F.when(strip("context") != strip("text"), F.concat(F.lit("\n   Contexte : "), F.substring("context", 1, 200))).otherwise("")
    lines = items.withColumn("nth", nth).withColumn("line", F.concat(line, more))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "line"))), lambda x: x["line"]), "\n")
    return lines.groupBy("doc_id").agg(F.concat(F.lit("Éléments à vérifier :\n"), body).alias("prompt"))


def anomalies(raw: DataFrame, items: DataFrame) -> DataFrame:
    """Reported anomalies as facts to be checked: empty and identical ones go, the page is the
    hint as given, else the item's, else 0; confidence is always the weakest."""
    orig, corr = strip(F.coalesce("original", F.lit(""))), F.nullif(strip(F.coalesce("corrected", F.lit(""))), F.lit(""))
    rows = raw.withColumns({"original_text": orig, "corrected_text": corr}).where((F.col("original_text") != "") & F.coalesce(F.lower("original_text") != F.lower("corrected_text"), F.lit(True)))
    kinds = items.select("job_id", "original_text", F.col("item_type").alias("_type"), F.col("page_num").alias("_page"))
    described = F.create_map(*(F.lit(x) for p in DESCRIPTIONS.items() for x in p))[F.coalesce("_type", F.lit("proper_noun"))]
    return rows.drop("item_type").join(kinds, ["job_id", "original_text"], "left").select(
        "id", F.coalesce("page_hint", "_page", F.lit(0)).alias("page_num"), F.lit("H").alias("category"), "original_text", "corrected_text", described.alias("description"), cut("explanation", 1000).alias("explanation"), cut("source", 300).alias("source"), F.lit("À vérifier").alias("confidence")
    )


# ── typography checker ─────────────────────────────────────────────────────


def decorative(text: Column) -> Column:
    t = strip(text)
    marks = F.length(t) - F.length(F.translate(t, PUNCTUATION, ""))
    return (t == "") | t.rlike(r"^[\s.\-–—_·•…]{3,}$") | ((F.length(t) > 2) & (marks / F.greatest(F.length(t), F.lit(1)) > 0.6))


def title_like(context: Column) -> Column:
    t = strip(context)
    return (F.length(t) < 80) & ~has_any(F.lower(t), VERB_MARKS)


def typographic(rule: Column, category: Column) -> Column:
    rule_up, cat_up = F.upper(rule), F.upper(category)
    return rule.isin(TYPOGRAPHY_RULES) | cat_up.isin(TYPOGRAPHY_CATEGORIES) | has_any(rule_up, TYPOGRAPHY_WORDS) | has_any(cat_up, TYPOGRAPHY_WORDS)


def typography_matches(matches: DataFrame) -> DataFrame:
    """Matches (rule_id, category_id, message, context, original) that stand."""
    return matches.where(
        ~F.col("rule_id").isin(SKIPPED_RULES)
        & ~has_any(F.col("message"), SKIPPED_MESSAGES)
        & typographic(F.col("rule_id"), F.col("category_id"))
        & (strip("original") != "")
        & ~decorative(F.col("original"))
        & ~(F.col("rule_id").isin(SENTENCE_END_RULES) & title_like(F.col("context")))
    )


# ── search checker ─────────────────────────────────────────────────────────


def unaccented(c: Column) -> Column:
    return F.translate(F.lower(c), MARKED, UNMARKED)


def search_query(item_type: Column, text: Column, context: Column) -> Column:
    return F.when(item_type == "date", F.concat(context, F.lit(" date exacte historique"))).when(item_type == "title", F.concat(text, F.lit(" livre roman auteur date publication"))).otherwise(F.concat(text, F.lit(" écrivain auteur biographie")))


def correct_date(original: Column, answer: str) -> Column:
    """The first of three date forms in the answer that is not the original date."""
    bare = lambda c: F.replace(F.lower(c), F.lit(" "), F.lit(""))
    own = F.replace(F.regexp_replace(F.lower(original), r"^[()]+|[()]+$", ""), F.lit(" "), F.lit(""))
    forms = [rf"(?iu)\b\d{{1,2}}\s+(?:{FR_MONTHS})\s+\d{{4}}\b", rf"(?iu)\b(?:{FR_MONTHS})\s+\d{{4}}\b", r"\b\d{4}\b"]
    found = [F.regexp_extract(answer, p, 0) for p in forms]
    return F.coalesce(*(F.when((f != "") & (bare(f) != own), f) for f in found))


def keyword_share(original: Column, combined: Column, strict: bool) -> Column:
    """Share of the original's words of four letters and more that the text has, whole or by
    their beginnings; null without such words."""
    found = F.regexp_extract_all(original, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){LETTER}{{4,}}(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    text = unaccented(combined)

    def worth(word: Column) -> Column:
        w = unaccented(word)
        whole = F.when(F.contains(text, w), 1.0)
        if strict:
            return whole.otherwise(0.0)
        return whole.when((F.length(w) >= 5) & F.contains(text, F.substring(w, 1, 5)), 0.7).when(F.contains(text, F.substring(w, 1, 4)), 0.5).otherwise(0.0)

    return F.when(F.size(found) > 0, F.aggregate(F.transform(found, worth), F.lit(0.0), lambda a, x: a + x) / F.size(found))


def keyword_match(original: Column, combined: Column, strict: bool) -> Column:
    return F.coalesce(keyword_share(original, combined, strict) >= MATCH_SHARE, F.lit(True))


def correct_name(original: Column, title: Column) -> Column:
    """The first capitalised phrase of a result's title that is near the name but not it."""
    found = F.regexp_extract_all(title, F.lit(r"(?U)(?<!\w)[A-ZÀ-Ü][a-zà-ü\-]{2,}(?:\s+[A-ZÀ-Ü][a-zà-ü\-]{2,})+"), F.lit(0))
    near = F.filter(found, lambda p: (unaccented(p) != unaccented(original)) & (F.abs(F.length(p) - F.length(original)) <= 4) & (F.substring(unaccented(p), 1, 4) == F.substring(unaccented(original), 1, 4)))
    return F.try_element_at(near, F.lit(1))


def correct_title(original: Column, text: Column) -> Column:
    """The first quoted phrase that shares a word of four letters with the title but is not it."""
    long = lambda c: F.regexp_extract_all(c, F.lit(rf"(?<![\p{{L}}\p{{N}}_]){LETTER}{{4,}}(?![\p{{L}}\p{{N}}_])"), F.lit(0))
    found = F.transform(F.regexp_extract_all(text, F.lit(r'[«“"]([^»”"]{5,80})[»”"]'), F.lit(1)), strip)
    near = F.filter(found, lambda t: F.arrays_overlap(long(t), long(original)) & (F.lower(t) != F.lower(original)))
    return F.try_element_at(near, F.lit(1))


def verdicts(items: DataFrame) -> DataFrame:
    """What a search says on items (with ``answer`` and ``results``, the joined snippets or null
    for none): silence where the fact is confirmed or, but for dates, nothing was found."""
    text, combined = F.col("text"), F.concat_ws(" ", "results", "answer")
    none = F.col("results").isNull()
    squeezed = lambda c: F.replace(unaccented(c), F.lit(" "), F.lit(""))
    is_date, is_title = F.col("item_type") == "date", F.col("item_type") == "title"
    silent = F.when(is_date, ~none & F.contains(squeezed(combined), squeezed(text))).when(is_title, none | keyword_match(text, combined, False)).otherwise(none | keyword_match(text, combined, True))
    corrected = F.when(is_date, F.when(~none, correct_date(text, "answer"))).when(is_title, correct_title(text, F.col("results"))).otherwise(correct_name(text, F.col("results")))
    said = F.when(is_date & none, "Date non vérifiable en ligne").when(is_date, "Date non confirmée — à vérifier").when(is_title, "Titre d'œuvre introuvable — à vérifier").otherwise("Orthographe du nom propre à vérifier")
    return items.where(~silent).withColumns({"corrected_text": corrected, "description": said, "category": F.when(is_date | is_title, "H").otherwise("A"), "confidence": F.when(is_date & none, "low").otherwise("medium")})
