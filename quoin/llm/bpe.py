"""BPE encoding and decoding.

A word is a doubly linked list of symbols. A priority queue holds the rank and place of
every adjacent pair that may merge; the lowest rank goes first, the leftmost among equals,
and an entry whose symbols have changed since it was queued is skipped as stale. Decoding
joins the vocabulary strings of the ids.

White space of ASCII parts texts to pieces; a task remembers the ids of the pieces it has met. The
new ones of many texts are parted to words, and each distinct new word is merged once. Words of up to
``WIDEST`` bytes are merged side by side, each with its list and its queue in a column of arrays: a
round takes the least entry of every queue. There an entry stands at its pair's place, so that a
merge overwrites or strikes out those that it makes stale. Longer words have a heap each.

The vocabulary is a ``tokenizers`` JSON file of kind BPE with an end-of-word suffix. The
driver reads it (a file of fixed size, about 2 MB) and broadcasts its tables.

Null text counts as empty; an empty text has no ids and decodes to the empty string. Texts
of any length are encoded whole. Repeated rows give repeated results, a table without rows none.
Columns beside the text are carried along; a column named ``ids`` or ``decoded`` is replaced.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from quoin.llm.common import gathered, text_or_empty

#: What the vocabulary's own file states as its word pattern. White space
#: is spelt out, for Python's ``\s`` also takes the separators U+001C to U+001F.
SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
WORDS = r"\p{L}+|'s|'t|'re|'ve|'m|'ll|'d|\p{N}|[^" + SPACE + r"\p{L}\p{N}]+"
#: The same pattern and its letters for texts of ASCII and the letters of Latin-1 only.
BEYOND_PLAIN = r"[^\x00-\x7fÀ-ÖØ-öø-ÿ]"
PLAIN_WORDS = r"[a-zß-öø-ÿ]+|'s|'t|'re|'ve|'m|'ll|'d|[0-9]|[^\t-\r a-z0-9ß-öø-ÿ]+"
#: What a file must state for ``WORDS`` and the normalising below to be its own.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
NORMALISERS = ["NFC", "Replace", "Lowercase"]
PAIR_BITS, PLACE_BITS = 32, 40
PLACES = (1 << PLACE_BITS) - 1
#: Pieces kept with their ids in a task; when more are held, they are forgotten and gathered anew.
KEPT = 400_000
#: Characters that a task encodes at once.
STEP_CHARS = 1_000_000
#: Bytes of the longest words that are merged side by side, and of narrower arrays for shorter ones.
WIDTHS = (8, 16, 32)
WIDEST = WIDTHS[-1]
#: An empty place of a queue; behind a rank, entries have the place in so many bits.
NONE, ENTRY_BITS = np.iinfo(np.int64).max, 8


def byte_symbols() -> list[str]:
    """A printable character for each byte: itself where printable, else from U+0100 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


def load(path: str) -> dict:
    """Vocabulary, pair ranks, word suffix and special tokens of a tokenizer file. A pair of
    ids is keyed by one integer, the left id in the high part."""
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    split = ((spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}])[0]
    normalisers = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    if split.get("pattern", {}).get("Regex") != PATTERN or normalisers != NORMALISERS:
        raise ValueError(f"{path} parts or normalises texts otherwise than is done here")
    model = spec["model"]
    ids = model["vocab"]
    merges = [pair if isinstance(pair, list) else pair.split(" ") for pair in model["merges"]]
    return {
        "ids": ids,
        "ranks": {ids[left] << PAIR_BITS | ids[right]: rank for rank, (left, right) in enumerate(merges)},
        "made": [ids[left + right] for left, right in merges],
        "suffix": model["end_of_word_suffix"] or "",
        "special": {t["content"]: t["id"] for t in spec["added_tokens"]},
    }


def merged(symbols: list[int], ranks: dict[int, int], made: list[int]) -> list[int]:
    """The symbols of one word after all merges. A queue entry is a rank and a place."""
    size = len(symbols)
    before, after = list(range(-1, size - 1)), [*range(1, size), -1]
    queue, rank_of = [], ranks.get
    for i in range(size - 1):
        rank = rank_of(symbols[i] << PAIR_BITS | symbols[i + 1])
        if rank is not None:
            queue.append(rank << PLACE_BITS | i)
    heapq.heapify(queue)
    while queue:
        entry = heapq.heappop(queue)
        i, rank = entry & PLACES, entry >> PLACE_BITS
        j = after[i]
        if j < 0 or symbols[i] < 0 or rank_of(symbols[i] << PAIR_BITS | symbols[j]) != rank:
            continue  # stale
        new = symbols[i] = made[rank]
        symbols[j] = -1
        k = after[i] = after[j]
        if k >= 0:
            before[k] = i
            rank = rank_of(new << PAIR_BITS | symbols[k])
            if rank is not None:
                heapq.heappush(queue, rank << PLACE_BITS | i)
        h = before[i]
        if h >= 0:
            rank = rank_of(symbols[h] << PAIR_BITS | new)
            if rank is not None:
                heapq.heappush(queue, rank << PLACE_BITS | h)
    return [s for s in symbols if s >= 0]


class Ranks:
    """Ranks of many pairs at once: a table of open addresses, probed one after the other."""

    def __init__(self, ranks: dict[int, int]):
        keys = np.fromiter(ranks, np.int64, len(ranks))
        bits = max(4, (4 * len(keys)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.ranks = np.full(1 << bits, -1), np.zeros(1 << bits, np.int64)
        at, left = self.home(keys), np.arange(len(keys))
        while left.size:
            free = self.keys[at[left]] < 0
            self.keys[at[left[free]]] = keys[left[free]]  # of those that want one address, one stays
            left = left[self.keys[at[left]] != keys[left]]
            at[left] = (at[left] + 1) & self.mask
        self.ranks[at] = np.fromiter(ranks.values(), np.int64, len(ranks))

    def home(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> self.shift).astype(np.int64)

    def of(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each pair; -1 for those that do not merge."""
        at = self.home(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.ranks[at], -1)
        left = np.flatnonzero((met != keys) & (met >= 0))
        while left.size:
            at[left] = (at[left] + 1) & self.mask
            met = self.keys[at[left]]
            hit = met == keys[left]
            out[left[hit]] = self.ranks[at[left[hit]]]
            left = left[~hit & (met >= 0)]
        return out


def merged_together(symbols: np.ndarray, sizes: np.ndarray, ranks: Ranks, made: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of many words after all merges, one word behind the other as they came, and
    how many each has. A word is a column; no word has more symbols than ``WIDEST``."""
    n, width = len(sizes), int(sizes.max())
    row = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    at = row * n + np.repeat(np.arange(n), sizes)
    symbol = np.full((width + 1) * n, -1)  # the row behind the last stands for the end of words
    symbol[at] = symbols
    before, after = (np.repeat(np.arange(width + 1) + k, n) for k in (-1, 1))
    queue = np.full(width * n, NONE)

    def queued(left: np.ndarray, i: np.ndarray, right: np.ndarray) -> None:
        """Put what now stands at the places ``left``, in row ``i``, in the queue in place of what was there."""
        rank = ranks.of(symbol[left] << PAIR_BITS | symbol[right])
        queue[left] = np.where(rank >= 0, rank << ENTRY_BITS | i, NONE)

    pair = symbol[at + n] >= 0
    queued(at[pair], row[pair], at[pair] + n)
    while True:
        least = queue.reshape(width, n).min(axis=0)
        word = np.flatnonzero(least < NONE)
        if not word.size:
            break
        i, rank = least[word] & (1 << ENTRY_BITS) - 1, least[word] >> ENTRY_BITS
        here = i * n + word
        there = after[here] * n + word
        k = after[there]
        symbol[here], symbol[there] = made[rank], -1
        queue[there] = queue[here] = NONE
        after[here] = k
        behind = k * n + word
        more = symbol[np.minimum(behind, width * n + word)] >= 0
        before[behind[more]] = i[more]
        h = before[here]
        less = h >= 0
        queued(np.r_[here[more], h[less] * n + word[less]], np.r_[i[more], h[less]], np.r_[behind[more], here[less]])
    left = symbol.reshape(width + 1, n).T
    kept = left >= 0
    return left[kept], kept.sum(axis=1)


class Codec:
    """Encoder and decoder of a task, with the pieces it has met at hand."""

    def __init__(self, tables: dict):
        import regex

        self.special = tables["special"]
        self.any = regex.compile(WORDS).findall
        self.plain = re.compile(PLAIN_WORDS).findall
        names = [""] * (1 + max([*tables["ids"].values(), *self.special.values()]))
        for name, k in [*tables["ids"].items(), *self.special.items()]:
            names[k] = name
        self.names = pa.array(names, pa.string())
        marks = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.split = re.compile(f"({marks})").split if marks else lambda text: [text]
        self.odd = re.compile("|".join(filter(None, [marks, BEYOND_PLAIN]))).search
        # a special token with a blank in it would be parted
        self.parts = not any(re.search(r"[\t-\r ]", x) for x in self.special)
        ids, suffix, symbols = tables["ids"], tables["suffix"], byte_symbols()
        self.inner = np.array([ids.get(x, -1) for x in symbols])
        self.last = np.array([ids.get(x + suffix, -1) for x in symbols])
        self.rank_of, self.made = tables["ranks"], tables["made"]
        self.ranks, self.made_of = Ranks(self.rank_of), np.array(self.made, np.int64)
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.int32)

    def words(self, piece: str) -> list[str]:
        """The words of a piece, special tokens among them."""
        if not self.odd(piece):
            return self.plain(piece.lower())
        out: list[str] = []
        for part in self.split(piece):
            # each character is lowered by itself: no final sigma
            out += [part] if part in self.special else self.any(unicodedata.normalize("NFC", part).replace("Σ", "σ").lower())
        return out

    def word_ids(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of words, one word behind the other, and how many each has."""
        if not len(words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        ends = np.frombuffer(words.buffers()[1], np.int32, len(words) + 1, 4 * words.offset).astype(np.int64)
        data = np.frombuffer(words.buffers()[2], np.uint8)[ends[0] : ends[-1]]
        ends, length = ends[1:] - ends[0], np.diff(ends)
        symbols = self.inner[data]
        symbols[ends - 1] = self.last[data[ends - 1]]
        # special tokens, and words with symbols outside the vocabulary, which have no id
        alone = np.minimum.reduceat(symbols, ends - length) < 0
        alone |= pc.is_in(words, pa.array(self.special, pa.string())).to_numpy(zero_copy_only=False)
        found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for low, high in zip((0, *WIDTHS), WIDTHS):
            chosen = ~alone & (length > low) & (length <= high)
            if chosen.any():
                found.append((np.flatnonzero(chosen), *merged_together(symbols[np.repeat(chosen, length)], length[chosen], self.ranks, self.made_of)))
        of = np.flatnonzero(alone | (length > WIDEST))
        if of.size:
            each = [self.one_word(words[i].as_py(), symbols[ends[i] - length[i] : ends[i]].tolist()) for i in of]
            found.append((of, np.fromiter(chain.from_iterable(each), np.int64), np.fromiter(map(len, each), np.int64, len(each))))
        order, ids, sizes = (np.concatenate(x) for x in zip(*found))
        back = np.argsort(order)
        return gathered(ids, (np.cumsum(sizes) - sizes)[back], sizes[back])

    def one_word(self, word: str, symbols: list[int]) -> list[int]:
        if word in self.special:
            return [self.special[word]]
        return merged([s for s in symbols if s >= 0], self.rank_of, self.made)

    def places(self, pieces: np.ndarray) -> np.ndarray:
        """Where what is known of each piece stands; -1 if nothing is."""
        return np.fromiter(map(self.known.get, pieces.tolist(), repeat(-1)), np.int64, len(pieces))

    def learn(self, pieces: list[str]) -> None:
        """Remember the ids of pieces that are not known yet."""
        joined = "\n".join(pieces)
        if self.parts and not self.odd(joined):  # no piece has a line end in it
            parted = list(map(self.plain, joined.lower().split("\n")))
        else:
            parted = list(map(self.words, pieces))
        met = pa.array(list(chain.from_iterable(parted)), pa.string()).dictionary_encode()
        of = met.indices.to_numpy()
        ids, sizes = self.word_ids(met.dictionary)
        flat, sizes = gathered(ids, (np.cumsum(sizes) - sizes)[of], sizes[of])
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(np.fromiter(map(len, parted), np.int64, len(parted)))]
        sizes = np.diff(ends, prepend=0)
        self.known.update(zip(pieces, range(len(self.starts), len(self.starts) + len(pieces))))
        self.starts = np.r_[self.starts, len(self.flat) + ends - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, flat.astype(np.int32)]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one text behind the other, and how many each has."""
        if len(self.known) > KEPT:
            self.forget()
        lists = pc.ascii_split_whitespace(texts) if self.parts else pa.ListArray.from_arrays(pa.array(range(len(texts) + 1), pa.int32()), texts)
        met = lists.flatten().dictionary_encode()
        pieces = met.dictionary.to_numpy(zero_copy_only=False)
        place = self.places(pieces)
        new = np.flatnonzero(place < 0)
        if new.size:
            place[new] = len(self.starts) + np.arange(new.size)
            self.learn(pieces[new].tolist())
        of = place[met.indices.to_numpy()]
        ids, sizes = gathered(self.flat, self.starts[of], self.sizes[of])
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        return ids, np.diff(np.r_[0, np.cumsum(sizes)][np.cumsum(counts)], prepend=0)

    def decode_all(self, lists: pa.ListArray) -> pa.Array:
        """The joined vocabulary strings of each list of ids."""
        return pc.binary_join(pa.ListArray.from_arrays(lists.offsets, self.names.take(lists.values)), " ")

    def encode(self, text: str) -> list[int]:
        return self.encode_all(pa.array([text], pa.string()))[0].tolist()

    def decode(self, ids: list[int]) -> str:
        return self.decode_all(pa.array([ids], pa.list_(pa.int32())))[0].as_py()


def listed(ids: np.ndarray, sizes: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), pa.array(ids, pa.int32()))


def encode(docs: DataFrame, path: str, text: str = "text", decoded: bool = False) -> DataFrame:
    """``docs`` with ``ids`` (array of int) in place of ``text``; with ``decoded`` also the
    string that the ids give back."""
    tables = docs.sparkSession.sparkContext.broadcast(load(path))
    keep = [c for c in docs.columns if c not in (text, "ids", "decoded")]
    frame = docs.select(*keep, text_or_empty(text).alias(text))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(tables.value)
        for batch in batches:
            step = np.cumsum(pc.binary_length(batch.column(len(keep))).to_numpy(zero_copy_only=False), dtype=np.int64) // STEP_CHARS
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(step)) + 1) if batch.num_rows else []:
                part = batch.slice(rows[0], len(rows))
                ids = listed(*codec.encode_all(part.column(len(keep))))
                columns = [*part.columns[:-1], ids] + [codec.decode_all(ids)] * decoded
                yield pa.RecordBatch.from_arrays(columns, names=[*keep, "ids"] + ["decoded"] * decoded)

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name in keep]
    return frame.mapInArrow(run, ", ".join([*types, "ids array<int>"] + ["decoded string"] * decoded))


def decode(rows: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """``rows`` with ``decoded``, the joined vocabulary strings of ``ids`` (null: empty)."""
    tables = rows.sparkSession.sparkContext.broadcast(load(path))
    keep = [c for c in rows.columns if c != "decoded"]
    where = keep.index(ids)
    frame = rows.select(*keep)

    def run(batches):
        codec = Codec(tables.value)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = [codec.decode(x or []) for x in part.column(where).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*keep, "decoded"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    return frame.mapInArrow(run, f"{types}, decoded string")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document: count, digest of the ids, digest of the decoded text."""
    from pyspark.sql import functions as F

    from quoin.llm.common import read

    rows = encode(read(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary(), decoded=True)
    return rows.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
