"""Quality rules by robust multivariate outliers.

Every document gets counts over its whole text. From them comes a vector of transformed
statistics, and for each (lang, source) a minimum-covariance-determinant estimate of its
place and spread. There are three starts, all without chance: medians and quartiles, the
correlation of the tanh of standardised rows, and that of their directions (spatial signs).
From each start, concentration steps keep the ``SUBSET`` of rows nearest by Mahalanobis
distance and take mean and covariance of those. The start whose covariance has the smallest
determinant in the end gives the estimate.

Groups of any size are treated alike: as in the regularised form of the estimator, a group's
mean and covariance are pooled with those of its language, and a language's with those of the
whole corpus, which weigh as much as ``PRIOR`` rows. A group of one row is so held against its
language, one of thousands against itself, and no covariance is singular.

A document whose distance exceeds its language's cut-off is rejected. That is the chi-square
quantile of ``share``, stretched as far as the upper half of the language's own distances is:
to their median and, in the exponent, to their upper quartile, each pooled with the corpus's.
It is also raised by as much as an estimate from so few rows as the document's group and its
prior have errs for new rows, by the quantile of Hotelling's distribution.
For normal rows it is the quantile itself; heavy tails move it out, and so do junk rows as they
come near a quarter of a language.

All rows take part in every step and no group is gathered: a step is one aggregation to
(group, start, bin of log distance) with sums of first and second moments, so a group of any
size shrinks to some hundred rows before the shuffle. Of the bin in which the subset ends the
fitting share of its sums is taken, so the subset has its exact size. Only the five by five
algebra is done in Python, once a group, start and step.

Null texts count as empty: no words. Null lang or source is a group of its own. Rows that fail
the base rules stay out of the estimates; where a group has no others, they have no distance.
Repeated rows are judged alike. Texts of any length are counted whole; from ``LONG`` words on
the repeated windows are found by sorting numbers, in memory of some 50 bytes a word. A table
without rows gives none. Columns beside the text are carried along, but for those named as results.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quoin.llm.common import guarded, per_text, read, text_or_empty, written
from quoin.session import cut

#: What counts as a symbol, and the base limits.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS, REPEAT_PERCENT = 50, 50

BLANKS = " \t\n\v\f\r"
UPPER, PUNCTUATION = bytes(range(65, 91)), bytes(b for b in range(33, 127) if not chr(b).isalnum())
#: Share of a group's rows that a concentration step keeps, steps, bins a unit of log distance.
SUBSET, STEPS, BINS = 0.75, 4, 16
#: Rows that a group's parent counts for in the group's estimate.
PRIOR = 60.0
LONG = 20_000
#: Words of five letters, nine tenths of them unlike, a tenth with a capital and a fifth with a
#: mark, that are added to each text.
USUAL_WORDS = 50
#: The statistics, each with the least spread that it is taken to have.
STATISTICS = {"x1": 0.3, "x2": 0.05, "x3": 0.05, "x4": 0.05, "x5": 0.05}
GROUPS_SENT = 20_000
TASK_ROWS = 200_000
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a window of three words which the text has twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    repeat = 0
    if len(set(windows)) < len(windows):
        often, end = Counter(windows), 0
        for i, window in enumerate(windows):
            if often[window] > 1:
                repeat += i + 3 - max(i, end)
                end = i + 3
    return repeat


def repeat_words_sorted(words: list[bytes]) -> int:
    """The same for long texts: words and pairs become numbers, so windows are numbers too."""
    numbers: dict[bytes, int] = {}
    x = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    pairs = np.unique(x[:-1] * len(numbers) + x[1:], return_inverse=True)[1]
    _, of, often = np.unique(pairs[:-1] * len(numbers) + x[2:], return_inverse=True, return_counts=True)
    first = np.r_[often[of] > 1, False, False]
    return int((first | np.r_[False, first[:-1]] | np.r_[False, False, first[:-2]]).sum())


def counts(text: str) -> tuple:
    octets = text.encode()
    words = octets.split()
    n = len(words)
    lines, seen, dup_lines = text.split("\n"), set(), 0
    for line in lines:
        if line.strip(BLANKS):
            if line in seen:
                dup_lines += 1
            else:
                seen.add(line)
    repeat = repeat_words(words) if n < LONG else repeat_words_sorted(words)
    chars = len(text) - sum(map(text.count, BLANKS))
    upper = len(octets) - len(octets.translate(None, UPPER))
    marks = len(octets) - len(octets.translate(None, PUNCTUATION))
    # shares of a short text vary more, so some usual words are counted with it
    more, shares = chars + 5 * USUAL_WORDS, (upper + 0.1 * USUAL_WORDS, marks + 0.2 * USUAL_WORDS)
    x = (
        math.log1p(n),
        math.log(more / (n + USUAL_WORDS)),
        math.log((len(set(words)) + 0.9 * USUAL_WORDS) / (n + USUAL_WORDS)),
        *(math.sqrt(share / more) for share in shares),
    )
    return (n, chars, sum(map(text.count, SYMBOLS)), dup_lines, repeat, *x)


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """The columns of ``docs`` but its text, the counts, ``base_failed`` and the vector."""
    fields = [(c, pa.int64()) for c in COUNTS] + [(c, pa.float64()) for c in STATISTICS]
    schema = ", ".join(f"{c} long" for c in COUNTS) + ", " + ", ".join(f"{c} double" for c in STATISTICS)
    keep = [c for c in docs.columns if c not in (*COUNTS, *STATISTICS, text, "base_failed")]
    rows = per_text(docs.select(*keep, text_or_empty(text).alias(text)), text, lambda: counts, fields, schema)
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    return rows.withColumn("base_failed", failed)


def chi_square(p: int, x):
    """Its distribution function, by the series of the incomplete gamma function."""
    a, x = p / 2, np.maximum(np.asarray(x, float) / 2, 1e-300)
    term = total = np.full(x.shape, 1 / a)
    for k in range(1, 500):
        term = term * x / (a + k)
        total = total + term
    return total * np.exp(-x + a * np.log(x) - math.lgamma(a))


def quantile(p: int, share: float) -> float:
    low, high = 0.0, 400.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(p, mid) < share else (low, mid)
    return low


def predicted(p: int, share: float, m: float) -> float:
    """The quantile of the squared distance of a new normal row from the mean and covariance of
    ``m`` rows: a multiple of F's, got by averaging over the chi-square of its denominator."""
    free = m - p
    t = np.linspace(max(1e-3, free - 12 * math.sqrt(2 * free)), free + 12 * math.sqrt(2 * free), 400)
    weight = (free / 2 - 1) * np.log(t) - t / 2
    weight = np.exp(weight - weight.max())
    low, high = 0.0, 400.0
    for _ in range(40):
        mid = (low + high) / 2
        low, high = (mid, high) if (weight * chi_square(p, mid * t / free)).sum() / weight.sum() < share else (low, mid)
    return low * (m * m - 1) / m / free


def allowance(share: float) -> tuple[float, float]:
    """a and b for which 1 + a / m + b / m^2 is about that quantile by the chi-square's."""
    x, y = 0.75 * PRIOR, 4 * PRIOR
    at = lambda m: (predicted(P, share, m) / quantile(P, share) - 1) * m
    b = (at(x) - at(y)) / (1 / x - 1 / y)
    return at(x) - b / x, b


def small(df: DataFrame, n: int):
    """A join side, broadcast where its counted rows stay under a fixed bound."""
    return F.broadcast(df) if n <= GROUPS_SENT else df


P = len(STATISTICS)
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
#: A group, its parent: the whole, languages, sources of a language.
LEVELS = [["_whole"], ["_whole", "_lang"], ["_whole", "_lang", "_source"]]
MEANS, COVARIANCES, PRECISIONS = [f"u{i}" for i in range(P)], [f"c{i}_{j}" for i, j in PAIRS], [f"w{i}_{j}" for i, j in PAIRS]


def few(rows: DataFrame, n: int) -> DataFrame:
    """``rows``, some ``n`` in number, in as few tasks as hold ``TASK_ROWS`` each: a task's partial
    sums are few beside its rows, and what follows in one task needs no exchange."""
    return rows.coalesce(1 + n // TASK_ROWS)


def gathered(sums: DataFrame, n: int) -> DataFrame:
    """The same for sums that are yet to be made: made where they meet, in all tasks, then moved."""
    return sums.repartition(1 + n // TASK_ROWS)


def narrow_bins(rows: DataFrame) -> DataFrame:
    """Exact counts of narrow bins of each statistic in each group of the finest level."""
    each = F.array(*(F.struct(F.lit(c).alias("c"), F.floor(F.col(c) / (spread / 10)).alias("bin")) for c, spread in STATISTICS.items()))
    keys = LEVELS[-1]
    return rows.select(*keys, F.explode(each).alias("_s")).groupBy(*keys, F.col("_s.c").alias("c"), F.col("_s.bin").alias("bin")).agg(F.count("*").alias("n"))


def quartiles(bins: DataFrame, keys: list[str]) -> DataFrame:
    """Rows ``n``, median ``m`` and spread ``s`` of each statistic, for each group."""
    width = {c: s / 10 for c, s in STATISTICS.items()}
    of = Window.partitionBy(*keys, "c")
    own = bins.groupBy(*keys, "c", "bin").agg(F.sum("n").alias("n"))
    ranked = own.withColumn("upto", F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0))).withColumn("all", F.sum("n").over(of))
    at = lambda q: F.min(F.when(F.col("upto") >= q * F.col("all"), F.col("bin")))
    each = ranked.groupBy(*keys, "c").agg(F.max("all").alias("all"), at(0.25).alias("q1"), at(0.5).alias("q2"), at(0.75).alias("q3"))
    out = [F.max("all").alias("rows")]
    for i, (c, least) in enumerate(STATISTICS.items()):
        mine = F.col("c") == c
        out.append(F.max(F.when(mine, (F.col("q2") + 0.5) * width[c])).alias(f"m{i}"))
        out.append(F.max(F.when(mine, F.greatest(F.lit(least), (F.col("q3") - F.col("q1")) * width[c] / 1.349))).alias(f"s{i}"))
    return each.groupBy(*keys).agg(*out)


def distance():
    """Squared Mahalanobis distance of the statistics under mean u and precision w."""
    d = [F.col(c) - F.col(f"u{i}") for i, c in enumerate(STATISTICS)]
    terms = [d[i] * d[j] * F.col(f"w{i}_{j}") * (1 if i == j else 2) for i, j in PAIRS]
    return sum(terms[1:], terms[0])


def square(pdf: pd.DataFrame, name: str) -> np.ndarray:
    out = np.zeros((len(pdf), P, P))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = pdf[f"{name}{i}_{j}"]
    return out


def pooled(rows: np.ndarray, mean: np.ndarray, spread: np.ndarray, pdf: pd.DataFrame) -> dict:
    """Mean, covariance, precision and log determinant, pooled with the parent's in ``pdf``
    (columns p...), to which nothing but the least spread is added where there is no parent."""
    if "pu0" in pdf:
        part = (rows / (rows + PRIOR))[:, None]
        mean = part * mean + (1 - part) * pdf[[f"p{c}" for c in MEANS]].to_numpy(float)
        spread = part[..., None] * spread + (1 - part[..., None]) * square(pdf, "pc")
    else:
        spread = spread + np.diag([(s / 4) ** 2 for s in STATISTICS.values()])
    inverse = np.linalg.inv(spread)
    out = {f"u{i}": mean[:, i] for i in range(P)}
    out |= {f"c{i}_{j}": spread[:, i, j] for i, j in PAIRS} | {f"w{i}_{j}": inverse[:, i, j] for i, j in PAIRS}
    return out | {"size": np.linalg.slogdet(spread)[1]}


def estimates(rows: DataFrame, bins: DataFrame, keys: list[str], parent: DataFrame | None) -> tuple[DataFrame, int]:
    """For each group its ``rows``, mean ``u``, covariance ``c`` and precision ``w``, and the
    number of groups. ``parent`` has the same for the groups above."""
    start = quartiles(bins, keys)
    if parent is not None:
        told = parent.select(*keys[:-1], *(F.col(c).alias(f"p{c}") for c in [*MEANS, *COVARIANCES]))
        start = start.join(told, keys[:-1])
    start = cut(start)
    n = start.count()
    x = list(STATISTICS)
    # turns the spread of the nearest SUBSET of normal rows into that of all
    factor = SUBSET / chi_square(P + 2, quantile(P, SUBSET))
    carried = [c for c in start.columns if c not in keys]
    names = ["start", *MEANS, *COVARIANCES, *PRECISIONS, "size"]
    schema = ", ".join([*(f"`{k}` string" for k in keys), "rows long", "start int", *(f"`{c}` double" for c in names[1:])])

    def begun(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            count = pdf["rows"].to_numpy(float)
            middle, scale = (np.stack([pdf[f"{c}{i}"] for i in range(P)], axis=1) for c in "ms")
            for k, name in enumerate(["", "t", "d"]):
                shape = np.broadcast_to(np.eye(P), (len(pdf), P, P))
                if name:
                    got = square(pdf, name) + 1e-9 * np.eye(P)
                    unit = np.sqrt(np.einsum("gii->gi", got))
                    shape = got / unit[:, :, None] / unit[:, None, :]
                yield pd.DataFrame({c: pdf[c] for c in [*keys, "rows"]} | {"start": k} | pooled(count, middle, shape * scale[:, :, None] * scale[:, None, :], pdf))

    z = [(F.col(c) - F.col(f"m{i}")) / F.col(f"s{i}") for i, c in enumerate(x)]
    seen = rows.join(small(start, n), keys).select(*keys, *(e.alias(f"z{i}") for i, e in enumerate(z)))
    far = sum((F.col(f"z{i}") * F.col(f"z{i}") for i in range(P)), F.lit(1e-9))
    signs = seen.groupBy(*keys).agg(
        *(F.avg(F.tanh(f"z{i}") * F.tanh(f"z{j}")).alias(f"t{i}_{j}") for i, j in PAIRS),
        *(F.avg(F.col(f"z{i}") * F.col(f"z{j}") / far).alias(f"d{i}_{j}") for i, j in PAIRS),
    )
    params = cut(few(start.join(gathered(signs, n), keys), n).mapInPandas(begun, schema))

    def solved(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            taken = pdf["n"].to_numpy(float)[:, None]
            mean = np.stack([pdf[f"a{i}"] for i in range(P)], axis=1) / taken
            spread = square(pdf, "b") / taken[..., None] - mean[:, :, None] * mean[:, None, :]
            yield pd.DataFrame({k: pdf[k] for k in [*keys, "rows", "start"]} | pooled(pdf["rows"].to_numpy(float), mean, spread * factor, pdf))

    for _ in range(STEPS if n else 0):
        by = [*keys, "start"]
        near = rows.join(small(params, 3 * n), keys).withColumn("bin", F.floor(F.log(distance() + 1e-9) * BINS))
        sums = {"n": F.count("*").cast("double")} | {f"a{i}": F.sum(c) for i, c in enumerate(x)} | {f"b{i}_{j}": F.sum(F.col(x[i]) * F.col(x[j])) for i, j in PAIRS}
        binned = gathered(near.groupBy(*by, "bin").agg(*(e.alias(c) for c, e in sums.items())), 3 * n * BINS * 20)
        of = Window.partitionBy(*by)
        upto, whole = F.sum("n").over(of.orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)), F.sum("n").over(of)
        share = F.greatest(F.lit(0.0), F.least(F.lit(1.0), (SUBSET * F.col("whole") - F.col("upto")) / F.col("n") + 1))
        inner = binned.withColumns({"upto": upto, "whole": whole}).withColumn("share", share).where("share > 0")
        taken = inner.groupBy(*by).agg(*(F.sum(F.col(c) * F.col("share")).alias(c) for c in sums))
        params = cut(few(taken, 3 * n).join(start.select(*keys, *(c for c in carried if c == "rows" or c.startswith("p"))), keys).mapInPandas(solved, schema))
    best = params.groupBy(*keys).agg(F.min_by(F.struct("rows", *MEANS, *COVARIANCES, *PRECISIONS), F.struct("size", "start")).alias("best"))
    return cut(few(best.select(*keys, "best.*"), n)), n


def cut_offs(rows: DataFrame, share: float) -> tuple[DataFrame, int]:
    """For each language the distance beyond which a row is an outlier, and their number."""
    middle, upper = quantile(P, 0.5), quantile(P, 0.75)
    logs = [F.log(F.percentile_approx(F.col("outlyingness") + 1e-9, q, 10_000)) for q in (0.5, 0.75)]
    # one row: a join by the constant key would be a product of all partitions with all
    whole = F.broadcast(rows.agg(logs[0].alias("all2"), logs[1].alias("all3")))
    each = rows.groupBy("_lang").agg(F.count("*").alias("n"), logs[0].alias("q2"), logs[1].alias("q3")).crossJoin(whole)
    part = F.col("n") / (F.col("n") + PRIOR)
    both = each.select("_lang", *((part * F.col(f"q{k}") + (1 - part) * F.col(f"all{k}")).alias(f"q{k}") for k in (2, 3)))
    stretch = F.greatest(F.lit(1.0), (F.col("q3") - F.col("q2")) / math.log(upper / middle))
    out = cut(both.select("_lang", F.exp(F.col("q2") + stretch * math.log(quantile(P, share) / middle)).alias("cutoff")))
    return out, out.count()


def outlying(rows: DataFrame, share: float = 0.9999) -> DataFrame:
    """``rows`` (``_lang``, ``_source``, the statistics, ``base_failed``) with ``outlyingness``
    (squared distance; null where no row of the group passes the base rules) and ``cutoff``."""
    rows = rows.withColumn("_whole", F.lit(""))
    fit = rows.where("NOT base_failed").select(*LEVELS[-1], *STATISTICS)
    fit = few(fit, fit.count())
    bins = written(narrow_bins(fit))
    bins = few(bins, bins.count())
    params, n = None, 0
    for keys in LEVELS:
        params, n = estimates(fit, bins, keys, params)
    told = params.select(*LEVELS[-1], *MEANS, *PRECISIONS, (SUBSET * (F.col("rows") + PRIOR)).alias("_m"))
    far = rows.join(small(told, n), LEVELS[-1], "left").withColumn("outlyingness", distance()).drop(*MEANS, *PRECISIONS)
    limits, m = cut_offs(far.where("NOT base_failed"), share)
    a, b = allowance(share)
    return far.join(small(limits, m), "_lang", "left").withColumn("cutoff", F.col("cutoff") * (1 + a / F.col("_m") + b / F.col("_m") ** 2)).drop("_whole", "_m")


def judge(docs: DataFrame, text: str = "text", share: float = 0.9999) -> DataFrame:
    """The columns of ``docs`` but its text, the counts, ``base_failed``, ``outlyingness``
    (squared distance; null without an estimate) and ``kept``."""
    own, back = guarded(docs, [text, *COUNTS, "base_failed", "outlyingness", "kept"])
    told = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for c, k in (("lang", "_lang"), ("source", "_source"))]
    rows = written(statistics(docs.select(*own, *told, text_or_empty(text).alias("_text")), "_text"))
    far = outlying(rows, share)
    kept = ~F.col("base_failed") & (F.col("outlyingness") <= F.col("cutoff"))
    return far.select(*back, *COUNTS, "base_failed", "outlyingness", F.coalesce(kept, F.lit(False)).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = judge(read(spark, sf_dir, "documents").select("doc_id", "lang", "source", "text"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "outlyingness")
