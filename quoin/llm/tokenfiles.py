"""Token ids in binary files: frequency-ranked ids, byte-aligned, with separate control bytes.

``write`` encodes texts with the ``tokenizers`` library, counts every id over all of them, and
writes the documents in ascending order. ``read`` gives them back. Under the folder lie

* ``ranks``, a Parquet table (id, n, rank): the most frequent id has rank 0;
* ``shards``, binary files in the order of their part numbers, each of about ``FILE_IDS`` ids;
* ``index``, a Parquet table (shard, n_docs, n_ids, start): where each file begins in the whole.

A file is a sequence of blocks. A block is a header, the documents' ids, null flags and
lengths, then the control bytes of all its ids, then their data bytes, then an end mark. A
control byte tells the widths of eight ids (one or two bytes each) or, where there are more
than 65,536 ranks, of four ids (one to four bytes each). Data bytes are the rank, low byte
first. Decoding looks control bytes up in a table of widths, with numpy, a block at a time.

The whole runs as Spark jobs: encoding, a count by id (as many rows as the vocabulary has), a
shuffle to ranges of (doc_id, digest of the ids), and Spark's own text writer, whose line
separator is the end mark, so files are committed as Spark commits them and any file system
will do. No row meets more than a block of others at a time.

Null texts count as empty; an empty text is the end id alone. Null doc_ids come first, rows of
one doc_id in the order of their ids' digests, repeated rows side by side. A doc_id is an
integer; other types are refused. Texts of any length are encoded whole. A table without rows
gives files without blocks, and no rows. Extra columns are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.bpe import PATTERN, vocabulary
from quoin.llm.common import gathered, text_or_empty, written
from quoin.llm.common import read as table
from quoin.session import shared_folder

END_ID = 1
#: Ids of a file and of a block; a longer document is a block, or a file, by itself.
FILE_IDS, BLOCK_IDS = 8_000_000, 500_000
#: Characters that a task encodes at once.
STEP_CHARS = 4_000_000
#: Pieces of text kept with their ids in a worker; when so many are held they are dropped.
KEPT = 1_000_000
#: Words that the library is given at once.
TOGETHER = 100
#: The library's pattern for lower-case letters of ASCII and Latin-1, and what may be
#: parted by it.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\s0-9a-zß-öø-ÿ]+"
PLAIN = r"[!-~À-ÖØ-öø-ÿ]"
MAGIC, MARK = b"QTK1", "\nQEND\n"
HEADER = struct.Struct("<4sBxxxIQQ")


# ── encoding ───────────────────────────────────────────────────────────────


class Encoder:
    """The library's ids for texts. White space parts what the library sees, so what lies between
    blanks is given to it once and remembered. What has letters of Latin-1 and ASCII only is
    parted further, by the library's own pattern, to words, figures and signs: each ends in one
    token that ends a word, which tells one word's ids from the next when many are given at once.
    Anything else, and what holds a special token, is given piece by piece."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        suffix = self.library.model.end_of_word_suffix
        vocabulary = self.library.get_vocab()
        self.wide = self.library.get_vocab_size() > 1 << 16
        self.ends = np.zeros(1 + max(vocabulary.values()), bool)
        self.ends[[k for name, k in vocabulary.items() if suffix and name.endswith(suffix)]] = True
        self.special = "|".join(re.escape(t.content) for t in self.library.get_added_tokens_decoder().values()) or "$^"
        # a vocabulary that does not end words so, or parts them otherwise, is used piece by piece
        state = json.loads(self.library.pre_tokenizer.__getstate__()) if self.library.pre_tokenizer else {}
        pattern = (state.get("pretokenizers") or [{}])[0].get("pattern", {}).get("Regex")
        letters = [chr(c) for c in range(33, 256) if re.match(PLAIN, chr(c))]
        self.plain = PLAIN if pattern == PATTERN and all(self.ends[self.ids_of([c])[0][-1]] for c in letters) else "$^"
        self.forget()

    def ids_of(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.starts, self.sizes = np.empty(0, np.int64), np.empty(0, np.int64)
        self.flat = np.empty(0, np.uint32)

    def remember(self, pieces: list[str], ids: np.ndarray, sizes: np.ndarray) -> None:
        first = len(self.starts)
        self.known.update(zip(pieces, range(first, first + len(pieces))))
        self.starts = np.r_[self.starts, len(self.flat) + np.cumsum(sizes) - sizes]
        self.sizes = np.r_[self.sizes, sizes]
        self.flat = np.r_[self.flat, ids]

    def places(self, pieces: list[str], words: bool) -> np.ndarray:
        """Where what is known of each piece stands; unknown ones are learnt."""
        new = [p for p in pieces if p not in self.known]
        if new and words:
            ids = np.concatenate(self.ids_of([" ".join(new[k : k + TOGETHER]) for k in range(0, len(new), TOGETHER)]))
            sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
            if len(sizes) != len(new):
                raise AssertionError("the library parted words otherwise")
            self.remember(new, ids, sizes)
        elif new:
            found = self.ids_of(new)
            self.remember(new, np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found)))
        return np.fromiter(map(self.known.__getitem__, pieces), np.int64, len(pieces))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, an end id behind each, and how many each text has."""
        if len(self.known) > KEPT:
            self.forget()
        array = lambda x: x.to_numpy(zero_copy_only=False)
        lists = pc.ascii_split_whitespace(texts)
        met = pc.dictionary_encode(lists.flatten())
        pieces = met.dictionary
        plain = pc.and_(pc.match_substring_regex(pieces, f"^(?:{PLAIN})+$" if self.plain == PLAIN else "$^x"), pc.invert(pc.match_substring_regex(pieces, self.special)))
        parted = pc.ascii_split_whitespace(pc.ascii_rtrim_whitespace(pc.replace_substring_regex(pc.utf8_lower(pieces.filter(plain)), f"({WORDS})", r"\1 ")))
        words = pc.dictionary_encode(parted.flatten())
        # each piece is some words, or known by itself
        mask = array(plain)
        count = np.ones(len(pieces), np.int64)
        count[mask] = array(pc.list_value_length(parted))
        by_word = np.repeat(mask, count)
        at = np.empty(len(by_word), np.int64)
        at[by_word] = self.places(words.dictionary.to_pylist(), True)[array(words.indices)]
        at[~by_word] = self.places(pieces.filter(pc.invert(plain)).to_pylist(), False)
        flat, sizes = gathered(self.flat, self.starts[at], self.sizes[at])
        ends = np.r_[0, np.cumsum(sizes)][np.cumsum(count)]
        starts = np.r_[0, ends[:-1]]
        of = array(met.indices)
        ids, sizes = gathered(flat, starts[of], (ends - starts)[of])
        bounds = np.r_[0, np.cumsum(sizes)][np.cumsum(array(pc.list_value_length(lists)))]
        return np.insert(ids, bounds, END_ID), np.diff(bounds, prepend=0) + 1


_ENCODERS: dict[str, Encoder] = {}


def encoded(docs: DataFrame, text: str, path: str) -> DataFrame:
    """(doc_id, n, ids): ids as bytes, two each where the vocabulary allows it, else four."""
    frame = docs.select(F.col("doc_id").cast("long"), text_or_empty(text).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _ENCODERS.setdefault(path, None) or Encoder(path)  # a worker serves many tasks
        _ENCODERS[path] = encoder
        for batch in batches:
            size = np.cumsum(pc.binary_length(batch.column(1)).to_numpy(zero_copy_only=False)) // STEP_CHARS if batch.num_rows else np.empty(0)
            for rows in np.split(np.arange(batch.num_rows), np.flatnonzero(np.diff(size)) + 1):
                if not len(rows):
                    continue
                part = batch.slice(rows[0], len(rows))
                ids, counts = encoder.encode(part.column(1))
                kind = "<u4" if encoder.wide else "<u2"
                data = ids.astype(kind)
                offsets = np.r_[0, np.cumsum(counts)] * data.itemsize
                if offsets[-1] < 1 << 31:
                    blobs = pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(offsets.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])
                else:
                    blobs = pa.array([data.tobytes()[a:b] for a, b in zip(offsets, offsets[1:])], pa.binary())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(counts, pa.int64()), blobs], names=["doc_id", "n", "ids"])

    return frame.mapInArrow(run, "doc_id long, n long, ids binary")


# ── the code ───────────────────────────────────────────────────────────────


def width_table(bits: int) -> np.ndarray:
    """Widths by control byte: ``8 // bits`` ids each, the first in the lowest bits."""
    shifts = np.arange(0, 8, bits)
    return (((np.arange(256)[:, None] >> shifts) & ((1 << bits) - 1)) + 1).astype(np.uint8)


def pack(ranks: np.ndarray, bits: int) -> tuple[bytes, bytes]:
    """Control and data bytes of ranks."""
    ranks = ranks.astype("<u4")
    width = 1 + sum((ranks >= 1 << 8 * k).astype(np.uint8) for k in range(1, 4))
    if bits == 1 and width.size and width.max() > 2:
        raise ValueError("a rank of more than two bytes needs two control bits")
    codes = np.zeros(-(-len(ranks) // (8 // bits)) * (8 // bits), np.uint8)
    codes[: len(ranks)] = width - 1
    control = (codes.reshape(-1, 8 // bits) << np.arange(0, 8, bits, dtype=np.uint8)).sum(axis=1, dtype=np.uint8)
    start = np.cumsum(width) - width
    data = np.empty(int(width.sum()), np.uint8)
    data[start] = ranks & 255
    for k in range(1, 1 << bits):
        more = np.flatnonzero(width > k)
        data[start[more] + k] = ranks[more] >> np.uint32(8 * k) & 255
    return control.tobytes(), data.tobytes()


def unpack(control: np.ndarray, data: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The ranks behind control and data bytes."""
    width = width_table(bits)[control].ravel()[:n]
    start = np.cumsum(width, dtype=np.int64) - width
    out = data[start].astype(np.uint32)
    for k in range(1, 1 << bits):
        more = np.flatnonzero(width > k)
        if not len(more):
            break
        out[more] |= data[start[more] + k].astype(np.uint32) << np.uint32(8 * k)
    return out


def block(doc_ids: pa.Array, counts: np.ndarray, ranks: np.ndarray, bits: int) -> bytes:
    control, data = pack(ranks, bits)
    known = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
    nulls = doc_ids.is_null().to_numpy(zero_copy_only=False).astype(np.uint8)
    return HEADER.pack(MAGIC, bits, len(counts), len(ranks), len(data)) + known.tobytes() + nulls.tobytes() + counts.astype("<u8").tobytes() + control + data


def blocks(content: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]]:
    """(doc ids, null flags, lengths, control bytes, data bytes, bits) of each block of a file."""
    at = 0
    while at < len(content):
        magic, bits, n_docs, n_ids, n_data = HEADER.unpack_from(content, at)
        if magic != MAGIC:
            raise ValueError(f"no block at byte {at}")
        at += HEADER.size
        parts = []
        for kind, n in (("<i8", n_docs), ("u1", n_docs), ("<u8", n_docs), ("u1", -(-n_ids // (8 // bits))), ("u1", n_data)):
            parts.append(np.frombuffer(content, kind, n, at))
            at += parts[-1].nbytes
        if content[at : at + len(MARK)] != MARK.encode():
            raise ValueError(f"the block before byte {at} has no end mark")
        at += len(MARK)
        yield *parts, bits


# ── writing and reading ────────────────────────────────────────────────────


def joined(blobs: pa.Array, wide: bool) -> np.ndarray:
    """The ids of all ``blobs``, one behind the other as they lie in the array."""
    if not len(blobs):
        return np.empty(0, np.uint32)
    ends = np.frombuffer(blobs.buffers()[1], np.int32, len(blobs) + 1, 4 * blobs.offset)
    return np.frombuffer(blobs.buffers()[2], np.uint8)[ends[0] : ends[-1]].view("<u4" if wide else "<u2")


def counted(rows: DataFrame, wide: bool) -> DataFrame:
    """(id, n): how often each id occurs. A task gives one row for each id it has met."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            found = np.bincount(joined(batch.column(0), wide))
            if len(found) > len(total):
                total = np.r_[total, np.zeros(len(found) - len(total), np.int64)]
            total[: len(found)] += found
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int32()), pa.array(total[ids], pa.int64())], names=["id", "n"])

    return rows.select("ids").mapInArrow(run, "id int, n long").groupBy("id").agg(F.sum("n").alias("n"))


def write(docs: DataFrame, path: str, tokenizer: str, text: str = "text") -> None:
    """Write the ids of ``docs`` (doc_id and ``text``) under the folder ``path``."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"doc_id is {docs.schema['doc_id'].dataType.simpleString()}, not an integer")
    spark = docs.sparkSession
    wide = Encoder(tokenizer).wide
    # equal keys part by a number that is written down, so it stays when a task runs again
    rows = written(encoded(docs, text, tokenizer).withColumn("tie", F.monotonically_increasing_id()), compression="zstd")
    # at most as many rows as the vocabulary has ids
    counts = sorted((-r["n"], r["id"]) for r in counted(rows, wide).collect())
    frame = spark.createDataFrame([(i, -n, k) for k, (n, i) in enumerate(counts)], "id int, n long, rank int")
    frame.coalesce(1).write.mode("overwrite").parquet(f"{path}/ranks")
    rank_of = np.zeros(1 + max((i for _, i in counts), default=0), np.uint32)
    rank_of[[i for _, i in counts]] = np.arange(len(counts))
    bits = 2 if len(counts) > 1 << 16 else 1
    ranks = spark.sparkContext.broadcast(rank_of)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[pa.Array, np.ndarray, np.ndarray]] = []

        def made() -> pa.RecordBatch:
            doc_ids, counts, ids = (x for x in zip(*held))
            one = block(pa.concat_arrays(doc_ids), np.concatenate(counts), ranks.value[np.concatenate(ids)], bits)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array([one], pa.binary())], names=["block"])

        for batch in batches:
            counts, ids = batch.column(1).to_numpy(), joined(batch.column(2), wide)
            ends = np.cumsum(counts)
            at = 0
            while at < batch.num_rows:
                # as many rows as a block has room for, one at least
                room = BLOCK_IDS - sum(len(x[2]) for x in held)
                before = int(ends[at - 1]) if at else 0
                to = int(np.searchsorted(ends, before + room, "right"))
                if to <= at and held:
                    yield made()
                    continue
                to = max(to, at + 1)
                held.append((batch.column(0).slice(at, to - at), counts[at:to], ids[before : int(ends[to - 1])]))
                at = to
        if held:
            yield made()

    files = max(1, -(-sum(-n for n, _ in counts) // FILE_IDS))
    key = [F.col("doc_id").asc_nulls_first(), F.xxhash64("ids"), F.col("tie")]
    dealt = rows.repartitionByRange(files, *key).sortWithinPartitions(*key)
    packed = dealt.select("doc_id", "n", "ids").mapInArrow(run, "block binary")
    # the text writer writes a string's bytes as they are
    packed.select(F.col("block").cast("string").alias("value")).write.mode("overwrite").option("lineSep", MARK).text(f"{path}/shards")
    indexed(spark, path).coalesce(1).write.mode("overwrite").parquet(f"{path}/index")


def _shards(spark: SparkSession, path: str) -> DataFrame:
    """(shard, content) of the files; Spark numbers them in the order of the ranges."""
    files = spark.read.format("binaryFile").load(f"{path}/shards")
    return files.select(F.regexp_extract("path", r"part-(\d+)", 1).cast("long").alias("shard"), "content")


def indexed(spark: SparkSession, path: str) -> DataFrame:
    """(shard, n_docs, n_ids, start): a row for each file, the ids of all files before it summed
    in one task, which gets as many rows as there are files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1)):
                counts = [x[2] for x in blocks(memoryview(content.as_buffer()).tobytes())]
                told = [len(c) for c in counts], [int(c.sum()) for c in counts]
                yield pa.RecordBatch.from_arrays([pa.array([shard.as_py()], pa.int64()), *(pa.array([sum(x)], pa.int64()) for x in told)], names=["shard", "n_docs", "n_ids"])

    files = _shards(spark, path).mapInArrow(run, "shard long, n_docs long, n_ids long")
    before = F.sum("n_ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    return files.withColumn("start", F.coalesce(before, F.lit(0)))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids) of every document: ids are bytes, four for each id, low
    byte first; start counts the ids of all documents before it."""
    table_of = spark.read.parquet(f"{path}/ranks").select("rank", "id").collect()  # the vocabulary at most
    ids_of = np.zeros(max(1, len(table_of)), np.uint32)
    ids_of[[r["rank"] for r in table_of]] = [r["id"] for r in table_of]
    ids = spark.sparkContext.broadcast(ids_of)
    names = ["shard", "doc_id", "before", "n_tokens", "ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, content in zip(batch.column(0), batch.column(1)):
                seen = 0
                for doc_ids, nulls, counts, control, data, bits in blocks(memoryview(content.as_buffer()).tobytes()):
                    found = ids.value[unpack(control, data, int(counts.sum()), bits)].astype("<u4")
                    ends = np.cumsum(counts).astype(np.int64)
                    starts = ends - counts.astype(np.int64)
                    blobs = pa.array([found[a:b].tobytes() for a, b in zip(starts, ends)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(counts), shard.as_py()), pa.int64()), pa.array(doc_ids, pa.int64(), mask=nulls.astype(bool)), pa.array(starts + seen, pa.int64()), pa.array(counts.astype(np.int64)), blobs], names=names)
                    seen += int(ends[-1])

    rows = _shards(spark, path).mapInArrow(run, "shard long, doc_id long, before long, n_tokens long, ids binary")
    index = spark.read.parquet(f"{path}/index").select("shard", F.col("start").alias("first"))
    return rows.join(index, "shard").select("doc_id", (F.col("first") + F.col("before")).alias("start"), "n_tokens", "ids")


def op12_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's place and length in the files, and the checksum of its ids."""
    path = f"{shared_folder(spark)}/quoin-tokens-{uuid.uuid4().hex}"
    write(table(spark, sf_dir, "documents").select("doc_id", "text"), path, vocabulary())
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
