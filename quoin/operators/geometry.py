"""Where corrections lie on their pages: words with places, phrase search, fallbacks, rectangles.

A words frame has doc_id, page_num, word_idx, word and x0, y0, x1, y1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.text import strip, words

# Characters that a search takes as equal.
PAIRS = [("’", "'"), ("‘", "'"), ("′", "'"), ("“", '"'), ("”", '"'), ("æ", "ae"), ("œ", "oe"), ("Æ", "AE"), ("Œ", "OE"), (" ", " "), (" ", " "), ("…", "...")]
BAND, WIDE_BAND, PREFIX = 4, 5, 30


def paired(c: Column | str) -> Column:
    out = F.col(c) if isinstance(c, str) else c
    for src, dst in PAIRS:
        out = F.replace(out, F.lit(src), F.lit(dst))
    return out


def normalised(c: Column | str) -> Column:
    return strip(F.regexp_replace(paired(c), " {2,}", " "))


def placed_words(pages: DataFrame) -> DataFrame:
    """Words of pages set ten to a line, in reading order."""
    rows = pages.select("doc_id", "page_num", F.posexplode(words("text")).alias("word_idx", "word"))
    x, y = (F.col("word_idx") % 10) * 50.0, F.floor(F.col("word_idx") / 10) * 14.5
    return rows.select("*", x.alias("x0"), y.alias("y0"), (x + 45.0).alias("x1"), (y + 12.0).alias("y1"))


def phrase(text: Column | str) -> Column:
    """The normalised words of a text, lower case. Blanks become blanks only, so the text is
    normalised once and then parted."""
    return words(F.lower(paired(text)))


def _asked(requests: DataFrame) -> DataFrame:
    return requests.withColumn("_phrase", phrase("original_text")).where(F.size("_phrase") > 0).withColumn("_first", F.col("_phrase")[0])


def _starts(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """The places of a document's pages where a phrase asked of it may begin: those of its first
    words, each with as many words as the longest phrase that begins so has. Pages are met once,
    and no place carries its page."""
    longest = asked.groupBy("doc_id", "_first").agg(F.max(F.size("_phrase")).alias("n"))
    wanted = longest.groupBy("doc_id").agg(F.map_from_entries(F.collect_list(F.struct("_first", "n"))).alias("_wanted"))  # the distinct first words asked of a document
    texts = pages.select("doc_id", F.col("page_num").alias("found_page"), phrase("text").alias("_words"))
    met = texts.join(wanted.hint("merge"), "doc_id")
    start = lambda w, i: F.struct(i.alias("word_idx"), w.alias("_first"), F.col("_wanted")[w].alias("n"))
    places = F.filter(F.transform("_words", start), lambda p: p["n"].isNotNull())
    behind = F.transform(places, lambda p: F.struct(p["word_idx"].alias("word_idx"), p["_first"].alias("_first"), F.slice("_words", p["word_idx"] + 1, p["n"]).alias("_behind")))
    return met.select("doc_id", "found_page", F.explode(behind).alias("p")).select("doc_id", "found_page", "p.*")


#: The words from a place on are those of the phrase.
_SAME = "slice(_behind, 1, size(_phrase)) = _phrase"


def matches(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """Every place of a request's phrase in its document: an equi-join on document and first
    word, then the words behind it. The first place on each page is kept. Places are many more rows
    than the tables' sizes tell, so neither side is sent whole to the driver."""
    asked = _asked(requests)
    met = asked.join(_starts(asked, pages).hint("merge"), ["doc_id", "_first"]).where(_SAME)
    return met.groupBy("request_id", "doc_id", "page_num", "found_page").agg(F.min("word_idx").alias("word_idx"), F.first(F.size("_phrase")).alias("n"))


def near_matches(requests: DataFrame, pages: DataFrame, band: int = BAND) -> DataFrame:
    """The places of a request's phrase on other pages within ``band`` of its own, the first on each
    page. An interval join: pages lie in bins as wide as the band, a request is dealt to the two
    bins that its band can touch, so pages further off are never met."""
    width = 2 * band + 1
    bins = F.array_distinct(F.array(F.floor((F.col("page_num") - band) / width), F.floor((F.col("page_num") + band) / width)))
    asked = _asked(requests)
    starts = _starts(asked, pages).withColumn("_bin", F.floor(F.col("found_page") / width))
    met = asked.withColumn("_bin", F.explode(bins)).join(starts.hint("merge"), ["doc_id", "_first", "_bin"]).where(F.abs(F.col("found_page") - F.col("page_num")).between(1, band) & F.expr(_SAME))
    return met.groupBy("request_id", "doc_id", "page_num", "found_page").agg(F.min("word_idx").alias("word_idx"), F.first(F.size("_phrase")).alias("n"))


def located(requests: DataFrame, pages: DataFrame, band: int = BAND) -> DataFrame:
    """The page and place of each request that is found: its own page, else the nearest pages
    first to last within the band, else the whole document in order. The best place so far is all
    that is kept of a request as its places are met."""
    away = F.abs(F.col("found_page") - F.col("page_num"))
    rank = F.when(away == 0, 0).when(away <= band, 1).otherwise(2)
    asked = _asked(requests)
    met = asked.join(_starts(asked, pages).hint("merge"), ["doc_id", "_first"]).where(_SAME)
    best = F.min(F.struct(rank.alias("step"), "found_page", "word_idx", F.size("_phrase").alias("n")))
    return met.groupBy("request_id", "doc_id").agg(best.alias("b")).select("request_id", "doc_id", "b.found_page", "b.word_idx", "b.n", "b.step")


def rectangles(found: DataFrame, placed: DataFrame) -> DataFrame:
    """One rectangle for each line that a found phrase touches; lines are told by rounded y0."""
    keys = found.select("request_id", "doc_id", F.col("found_page").alias("page_num"), F.explode(F.sequence("word_idx", F.col("word_idx") + F.col("n") - 1)).alias("word_idx"))
    rows = keys.join(placed.hint("merge"), ["doc_id", "page_num", "word_idx"]).withColumn("line", F.bround("y0", 0))
    return rows.groupBy("request_id", "page_num", "line").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))


def strategies(requests: DataFrame, pages: DataFrame) -> DataFrame:
    """The first search that finds each request on its own page: as it stands (1), normalised
    (2), word by word (3), by its first 30 characters (4)."""
    rows = requests.join(pages.withColumnRenamed("text", "_page").hint("merge"), ["doc_id", "page_num"], "left")
    text, page = strip("original_text"), F.coalesce("_page", F.lit(""))
    inside = lambda needle, hay: F.contains(F.lower(hay), F.lower(needle))
    run = F.concat(F.lit(" "), F.array_join(phrase("original_text"), " "), F.lit(" "))
    line = F.concat(F.lit(" "), F.array_join(phrase(page), " "), F.lit(" "))
    found = (
        F.when(inside(text, page), 1)
        .when(inside(normalised(text), normalised(page)), 2)
        .when(F.contains(line, run), 3)
        .when((F.length(text) > PREFIX) & inside(F.rtrim(F.substring(text, 1, PREFIX)), page), 4)
    )
    return rows.select("request_id", found.alias("strategy"))


def annotation_stats(requests: DataFrame, found: DataFrame) -> DataFrame:
    """For each category: asked, annotated, failed, failure rate and whether that alarms."""
    hit = found.select("request_id", F.lit(1).alias("hit"))
    rows = requests.join(hit, "request_id", "left").groupBy("category").agg(F.count("*").alias("asked"), F.count("hit").alias("annotated"))
    rate = 1 - F.col("annotated") / F.col("asked")
    return rows.select("category", "asked", "annotated", (F.col("asked") - F.col("annotated")).alias("failed"), F.round(rate, 3).alias("failure_rate"), (rate > 0.15).alias("alert"))


def without_large_fonts(spans: DataFrame, most: float = 36.0) -> DataFrame:
    """Page text from spans of at most ``most`` points. A line whose visible spans are all larger
    goes as a whole, blank lines too."""
    visible = F.regexp_replace("text", r"\s", "") != ""
    small = F.max(F.when(visible, F.col("size") <= most))
    part = F.when(F.col("size") <= most, F.struct("span", "text"))
    lines = spans.groupBy("doc_id", "page_num", "line").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["text"]), "").alias("text"), F.coalesce(small, F.lit(False)).alias("small"))
    kept = lines.where("small").where(F.regexp_replace("text", r"\s", "") != "")
    return kept.groupBy("doc_id", "page_num").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text"))), lambda p: p["text"]), "\n").alias("text"))
