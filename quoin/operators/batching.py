"""Windows over ordered text: overlapping page batches, budgets, chunks, samples, groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quoin.functions.text import BLANK, key, words

PAGE_MARK = "\n--- PAGE "
LEAST_PER_PAGE, HEADER = 200, 25


def batch_size(pages: Column) -> Column:
    return F.when(pages <= 30, 3).when(pages <= 100, 4).otherwise(5)


def nonblank(pages: DataFrame) -> DataFrame:
    """Pages with text, with ``n_pages`` (all pages of the document) and ``nth`` among those with text."""
    doc = Window.partitionBy("doc_id")
    counted = pages.withColumn("n_pages", F.count("*").over(doc)).where(F.regexp_replace("text", BLANK, "") != "")
    return counted.withColumns({"nth": F.row_number().over(doc.orderBy("page_num")) - 1, "n_text": F.count("*").over(doc)})


def batches(pages: DataFrame) -> DataFrame:
    """Each page with text in the batches that hold it; neighbours overlap by one page from
    size four on. Page k lies in batch b where b * stride <= k < b * stride + size."""
    rows = nonblank(pages).withColumn("size", batch_size(F.col("n_pages")))
    rows = rows.withColumn("stride", F.when(F.col("size") >= 4, F.col("size") - 1).otherwise(F.col("size")))
    first = F.greatest(F.lit(0), F.ceil((F.col("nth") - F.col("size") + 1) / F.col("stride")).cast("int"))
    last = F.floor(F.col("nth") / F.col("stride")).cast("int")
    return rows.withColumn("batch", F.explode(F.sequence(first, last))).select("doc_id", "batch", "page_num")


def marked(page_num: Column, text: Column) -> Column:
    return F.concat(F.lit(PAGE_MARK), (page_num + 1).cast("string"), F.lit(" ---\n"), text)


def condensed(pages: DataFrame, most: int) -> DataFrame:
    """Each document's marked text within a budget: whole if it fits, else every page keeps 200
    characters and its share of the rest, cut at its last blank."""
    doc = Window.partitionBy("doc_id")
    rows = nonblank(pages).withColumns({"whole": marked(F.col("page_num"), F.col("text")), "n": F.length("text")})
    rows = rows.withColumns({"all": F.sum(F.length("whole")).over(doc), "chars": F.sum("n").over(doc)})
    free = F.greatest(F.lit(0), most - F.col("n_text") * (LEAST_PER_PAGE + HEADER))
    rows = rows.withColumn("budget", (LEAST_PER_PAGE + F.floor(free * (F.col("n") / F.col("chars")))).cast("int"))
    kept = F.substring("text", F.lit(1), F.col("budget"))
    back = F.instr(F.reverse(kept), " ")
    space = F.when(back > 0, F.length(kept) - back).otherwise(-1)
    inside = (F.col("n") > F.col("budget")) & ~F.substring("text", F.col("budget") + 1, F.lit(1)).rlike(BLANK)
    short = F.when(inside & (space > LEAST_PER_PAGE), F.substring(kept, F.lit(1), space)).otherwise(kept)
    part = F.when(F.col("all") <= most, F.col("whole")).otherwise(marked(F.col("page_num"), short))
    parts = F.array_sort(F.collect_list(F.struct("page_num", part.alias("part"))))
    return rows.groupBy("doc_id").agg(F.array_join(F.transform(parts, lambda p: p["part"]), "").alias("text"))


def chunks(texts: DataFrame, single: int, size: int, lap: int, most: int) -> DataFrame:
    """(doc_id, chunk, start, stop): overlapping pieces of long texts, each ending before the
    last page mark in its second half if there is one. As a piece begins where the last one
    ended, ``most`` steps are spelt out as columns of one projection each."""
    mark, width = F.lit(PAGE_MARK), len(PAGE_MARK)
    rows = texts.withColumns({"total": F.length("text"), "start": F.lit(0), "found": F.array().cast("array<struct<start:int,stop:int>>")})
    for _ in range(most):
        hard = F.least(F.col("start") + size, F.col("total"))
        half = F.substring("text", F.col("start") + size // 2 + 1, hard - F.col("start") - size // 2)
        back = F.instr(F.reverse(half), PAGE_MARK[::-1])
        mark_at = F.col("start") + size // 2 + F.length(half) - back - width + 1
        rows = rows.withColumn("stop", F.when((hard < F.col("total")) & (back > 0), mark_at).otherwise(hard))
        rows = rows.withColumn("found", F.when(F.col("start") < F.col("total"), F.concat("found", F.array(F.struct("start", "stop")))).otherwise(F.col("found")))
        rows = rows.withColumn("start", F.greatest(F.col("start") + 1, F.when(F.col("start") < F.col("total"), F.col("stop") - lap).otherwise(F.col("total"))))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.col("total").alias("stop")))
    pieces = F.when(F.col("total") <= single, whole).otherwise(F.col("found"))
    return rows.select("doc_id", F.posexplode(pieces).alias("chunk", "piece")).select("doc_id", "chunk", "piece.start", "piece.stop")


def fixed_chunks(texts: DataFrame, size: int) -> DataFrame:
    starts = F.sequence(F.lit(0), F.length("text") - 1, F.lit(size))
    return texts.where("length(text) > 0").select("doc_id", "text", F.explode(starts).alias("start")).select("doc_id", "start", F.substring("text", F.col("start") + 1, F.lit(size)).alias("piece"))


def first_of_key(rows: DataFrame) -> DataFrame:
    order = Window.partitionBy("job_id", "page_number", "category", key("original_text")).orderBy("seq")
    return rows.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def grey_pages(pages: DataFrame, corrections: DataFrame, least: int = 8, most: int = 30, group: int = 5) -> DataFrame:
    """Pages with text and without a correction of A to D, of documents of eight pages or more."""
    fixed = corrections.where(F.col("category").isin(list("ABCD"))).select("doc_id", F.col("page_number").alias("page_num")).distinct()
    rows = nonblank(pages).where(F.col("n_pages") >= least).join(fixed, ["doc_id", "page_num"], "left_anti")
    numbered = rows.withColumn("rank", F.row_number().over(Window.partitionBy("doc_id").orderBy("page_num"))).where(F.col("rank") <= most)
    return numbered.select("doc_id", "page_num", F.floor((F.col("rank") - 1) / group).cast("int").alias("batch"))


def groups_of(rows: DataFrame, by: str, order: list[str], size: int) -> DataFrame:
    return rows.withColumn("grp", F.floor((F.row_number().over(Window.partitionBy(by).orderBy(*order)) - 1) / size).cast("int"))


def sample(pages: DataFrame, most_pages: int = 15, most_chars: int = 25_000) -> DataFrame:
    return condensed(nonblank(pages).where(F.col("nth") < most_pages).select("doc_id", "page_num", "text"), most_chars)


def already_found(corrections: DataFrame, most: int = 100) -> DataFrame:
    """One block of lines on the first A, B and C rows of each job."""
    rows = corrections.where(F.col("category").isin("A", "B", "C")).withColumn("_n", F.row_number().over(Window.partitionBy("job_id").orderBy("seq"))).where(F.col("_n") <= most)
    line = F.format_string("  p.%d [%s] « %s »", F.col("page_number") + 1, F.col("category"), F.substring("original_text", 1, 60))
    return rows.groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("line")))), lambda x: x["line"]), "\n").alias("context"))


def names_message(variants: DataFrame, most: int = 30) -> DataFrame:
    """The block on attested names that opens a batch's message: the first names, those of
    several forms with all of them."""
    forms = variants.groupBy("doc_id", "name").agg(F.array_sort(F.collect_set("form")).alias("forms"))
    named = forms.withColumn("nth", F.row_number().over(Window.partitionBy("doc_id").orderBy("name"))).where(F.col("nth") <= most)
    line = F.when(F.size("forms") == 1, F.concat(F.lit("  • "), F.col("name"))).otherwise(F.concat(F.lit("  • "), F.col("name"), F.lit(" — variantes : "), F.array_join("forms", ", "), F.lit(" → à signaler en F")))
    lines = F.array_sort(F.collect_list(F.struct("nth", line.alias("line"))))
    return named.groupBy("doc_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "\n").alias("message"))


def word_share(text: str) -> Column:
    return F.size(words(text))
