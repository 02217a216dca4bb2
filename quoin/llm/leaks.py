"""Benchmark decontamination by the q-gram lemma.

A passage of n characters that lies in a text with at most k edits shares at least
``n + 1 - (k + 1) q`` q-grams with it, and those lie on diagonals no more than k apart. The
benchmark's q-grams are indexed by a rolling hash; a text's hits are counted in bands of
diagonals that overlap by k. Bands that reach the item's bound are kept and verified by a
banded alignment of the whole item.

Texts and items are compared in lower case, runs of white space and ASCII punctuation as one
blank, by code points. Texts are searched whole, in one scan; nothing is shuffled. The index is
made in slices of about ``INDEX_CHARS`` characters of benchmark text, on the driver, one after
the other, and shipped as files, which all workers of a node map: what a worker holds itself
does not grow with the benchmark.

Items shorter than ``q / rate`` get the largest edit budget that leaves the bound positive.
Items shorter than a q-gram have none: they are found where their words stand in the text in
a run. Null and empty texts have no leaks; items that are null or without a letter or digit
are never found. Repeated items are each reported; repeated rows of documents are each judged.
Without items or documents there are no leaks. Extra columns are carried along; one named
``leaks`` is replaced.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import guarded, mapped, per_text, read, shipped, text_or_empty

Q, RATE = 12, 0.06
#: Characters of benchmark text in one slice of the index, but for one longer item.
INDEX_CHARS = 4_000_000
FILTER_BITS = 23
NONE = np.iinfo(np.int64).min
LEAKS = "array<struct<item_id: long, distance: int, start: int, end: int>>"
BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1

_BLANK = bytes(32 if b < 128 and not chr(b).isalnum() else b for b in range(256))


def plain(text: str) -> bytes:
    return b" ".join(text.lower().encode().translate(_BLANK).split())


def code_points(text: bytes) -> np.ndarray:
    return np.frombuffer(text.decode().encode("utf-32-le"), np.uint32)


def hashes(points: np.ndarray) -> np.ndarray:
    """A hash of the Q code points from each place on, by doubling."""
    h1 = points.astype(np.uint64)
    n = len(h1) - Q + 1
    power = lambda k: np.uint64(pow(BASE, k, 1 << 64))
    h2 = h1[:-1] * power(1) + h1[1:]
    h4 = h2[:-2] * power(2) + h2[2:]
    h8 = h4[:-4] * power(4) + h4[4:]
    return h8[:n] * power(4) + h4[8 : 8 + n]


def slot(found: np.ndarray) -> np.ndarray:
    return ((found * np.uint64(BASE)) >> np.uint64(64 - FILTER_BITS)).astype(np.int64)


def built(items: list[tuple[int | None, str]]) -> dict[str, np.ndarray]:
    """The arrays of an index: each item's id, edit budget, bound and code points, and the
    items' q-grams with their owners and places, by hash."""
    ids, edits, bound, texts, keys, owner, place = [], [], [], [], [], [], []
    for item, text in items:
        points = code_points(plain(text))
        n = len(points)
        if not n:
            continue
        k = min(int(RATE * n), (n - Q) // Q)
        if n >= Q:
            found = hashes(points)
            keys.append(found)
            owner.append(np.full(len(found), len(ids), np.int32))
            place.append(np.arange(len(found), dtype=np.int32))
        ids.append(NONE if item is None else item)
        texts.append(points)
        edits.append(max(0, k))
        bound.append(n + 1 - (k + 1) * Q)
    joined = lambda parts, kind: np.concatenate(parts) if parts else np.empty(0, kind)
    every = joined(keys, np.uint64)
    order = np.argsort(every, kind="stable")
    unique, start = np.unique(every[order], return_index=True)
    seen = np.zeros(1 << FILTER_BITS, bool)
    seen[slot(unique)] = True
    return {
        "ids": np.array(ids, np.int64),
        "edits": np.array(edits, np.int64),
        "bound": np.array(bound, np.int64),
        "ends": np.cumsum([0, *map(len, texts)], dtype=np.int64),
        "points": joined(texts, np.uint32),
        "keys": unique,
        "start": np.r_[start, len(every)].astype(np.int64),
        "owner": joined(owner, np.int32)[order],
        "place": joined(place, np.int32)[order],
        "filter": seen,
    }


class Index:
    """One slice of the benchmark, over the arrays of ``built``."""

    def __init__(self, arrays: dict[str, np.ndarray]):
        self.__dict__.update(arrays)
        self.width = int(self.edits.max(initial=0)) + 1
        self.short: dict[bytes, list[int]] = {}
        for own in np.flatnonzero(np.diff(self.ends) < Q).tolist():
            self.short.setdefault(self.text(own).tobytes().decode("utf-32-le").encode(), []).append(own)
        self.words = {phrase: set(phrase.split()) for phrase in self.short}

    def text(self, own: int) -> np.ndarray:
        return self.points[self.ends[own] : self.ends[own + 1]]

    def phrases(self, text: bytes, words: set[bytes]) -> list[tuple[int, int, int, int]]:
        """(item, 0, start, end) of the short items whose words stand in the text in a run."""
        out = []
        for phrase, needed in self.words.items():
            if needed <= words and (at := (b" " + text + b" ").find(b" " + phrase + b" ")) >= 0:
                start = len(text[:at].decode())
                out += [(own, 0, start, start + len(phrase.decode())) for own in self.short[phrase]]
        return out

    def regions(self, points: np.ndarray, found: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(item, distance, start, end) of the best region of every item that lies in the text
        within its budget. ``found`` has the hashes of the text's q-grams."""
        if not len(found) or not len(self.keys):
            return []
        at = np.flatnonzero(self.filter[slot(found)])
        k = np.minimum(np.searchsorted(self.keys, found[at]), len(self.keys) - 1)
        real = self.keys[k] == found[at]
        at, k = at[real], k[real]
        if not len(at):
            return []
        many = self.start[k + 1] - self.start[k]
        first = np.repeat(self.start[k] - np.r_[0, np.cumsum(many)[:-1]], many)
        entry = first + np.arange(many.sum())
        owner = self.owner[entry].astype(np.int64)
        diagonal = np.repeat(at, many) - self.place[entry]
        # bands of `width` diagonals, each reaching k further; a hit near a band's start is also the last one's
        band = diagonal // self.width
        also = diagonal - band * self.width < self.edits[owner]
        owner2, band2 = np.r_[owner, owner[also]], np.r_[band, band[also] - 1]
        low = int(band2.min())
        span = int(band2.max()) - low + 1
        keys, counts = np.unique(owner2 * span + (band2 - low), return_counts=True)
        owners, bands = keys // span, keys % span + low
        kept = counts >= self.bound[owners]
        best: dict[int, tuple[int, int, int]] = {}
        for own, b in zip(owners[kept].tolist(), bands[kept].tolist()):
            if own in best and best[own][0] == 0:
                continue
            budget, item = int(self.edits[own]), self.text(own)
            start = max(0, b * self.width - budget)
            end = min(len(points), (b + 1) * self.width + 2 * budget + len(item))
            region = aligned(item, points[start:end], budget)
            if region and (own not in best or region[0] < best[own][0]):
                best[own] = (region[0], start + region[1], start + region[2])
        return [(own, *region) for own, region in best.items()]


def leaks(indexes: list[Index], text: str) -> list[dict]:
    """What is found of the benchmark in a text, in the order of the items."""
    octets = plain(text)
    points = code_points(octets)
    found = hashes(points) if len(points) >= Q else np.empty(0, np.uint64)
    words = set(octets.split()) if any(index.short for index in indexes) else set()
    out = []
    for index in indexes:
        for own, distance, start, end in index.regions(points, found) + (index.phrases(octets, words) if index.short else []):
            item = int(index.ids[own])
            out.append({"item_id": None if item == NONE else item, "distance": distance, "start": start, "end": end})
    return sorted(out, key=lambda x: (x["item_id"] is not None, x["item_id"] or 0, x["start"], x["end"]))


def whole(item: np.ndarray, window: np.ndarray) -> int:
    """Where the item lies in the window without an edit, or -1."""
    needle, hay = item.tobytes(), window.tobytes()
    at = hay.find(needle)
    while at >= 0 and at % item.itemsize:
        at = hay.find(needle, at + 1)
    return at // item.itemsize if at >= 0 else -1


def aligned(item: np.ndarray, window: np.ndarray, budget: int) -> tuple[int, int, int] | None:
    """Distance, start and end of the item's nearest place in the window, if within budget.

    Rows run over the item, columns over the window, whose start and end are free. Only the
    diagonals of the window's band are there, as the window is no wider than it."""
    n, m = len(item), len(window)
    if (at := whole(item, window)) >= 0:
        return 0, at, at + n
    far = budget + 1
    width = m - n + 2 * budget + 1  # diagonals from -budget to m - n + budget
    if width <= 0:
        return None
    # column = row + offset - budget, offset from 0 to width - 1
    offsets = np.arange(width)
    columns = offsets - budget
    cost = np.where((columns >= 0) & (columns <= m), 0, far).astype(np.int64)
    begin = np.clip(columns, 0, m)
    for i in range(1, n + 1):
        columns = columns + 1
        inside = (columns >= 0) & (columns <= m)
        letter = np.where((columns >= 1) & (columns <= m), window[np.clip(columns - 1, 0, m - 1)], 0)
        same = (letter != item[i - 1]).astype(np.int64)
        diagonal = np.where(columns >= 1, cost + same, far)
        above = np.r_[cost[1:], far] + 1
        above_begin = np.r_[begin[1:], 0]
        take = above < diagonal
        best = np.where(take, above, diagonal)
        first = np.where(take, above_begin, begin)
        best = np.where(inside, best, far)
        # moves along the row: the least of best[j] + (offset - j) over j up to offset
        shifted = best - offsets
        source = np.maximum.accumulate(np.where(shifted <= np.minimum.accumulate(shifted), offsets, 0))
        cost = np.minimum(shifted[source] + offsets, far)
        cost = np.where(inside, cost, far)
        begin = first[source]
        if cost.min() >= far:
            return None
    j = int(np.argmin(cost))
    return int(cost[j]), int(begin[j]), int(columns[j])


def flagged(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``leaks``: (item_id, distance, start, end) of each item found, places in
    the compared form of the text."""
    spark = docs.sparkSession
    items = benchmark.where("text IS NOT NULL").select(F.col("item_id").cast("long").alias("item_id"), "text")
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    slices = max(1, -(-total // INDEX_CHARS))
    names = []
    for k in range(slices):
        part = items.where(F.pmod(F.xxhash64("text"), F.lit(slices)) == k)
        rows = sorted(((r.item_id, r.text) for r in part.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        names.append(shipped(spark, built(rows)))
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("distance", pa.int32()), ("start", pa.int32()), ("end", pa.int32())]))

    def make():
        indexes = [Index(mapped(SparkFiles.get(name))) for name in names]
        return lambda value: (leaks(indexes, value),)

    own, back = guarded(docs, ["leaks"])
    scanned = per_text(docs.select(*own, text_or_empty(text).alias("_text")), "_text", make, [("_leaks", kind)], f"_leaks {LEAKS}")
    return scanned.select(*back, F.col("_leaks").alias("leaks"))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` without a leak."""
    return flagged(docs, benchmark, text).where(F.size("leaks") == 0).select(*docs.columns)


def op10_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each document and benchmark item found in it."""
    found = flagged(read(spark, sf_dir, "documents").select("doc_id", "text"), read(spark, sf_dir, "benchmark"))
    return found.select("doc_id", F.explode("leaks").alias("leak")).select("doc_id", "leak.*")
