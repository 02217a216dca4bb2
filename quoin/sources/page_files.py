"""Page files as a data source: text files whose pages end with a form feed.

``spark.read.format("page_files").load(path)`` gives (path, split, nth, text). Files are cut into
splits of ``splitBytes``; a page belongs to the split in which it begins, and is read to its end, so
a file of any size is read by many tasks and a task holds a block and a page at most. A task reads
several splits if they are small. What number a
page has in its file is known once the splits before it are counted: with the option ``count`` the
source gives (path, split, pages) instead, and ``read_pages`` puts the two together.

A path that leads to no file, and a file without a page, are errors; so are bytes that are not UTF-8.
A form feed at the end of a file ends its last page and begins none.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from quoin.functions.text import words

BREAK, BLOCK, BATCH = b"\f", 1 << 20, 1_000
SPLIT_BYTES = 32 << 20
#: Small splits are put together to tasks of so many bytes, as a task costs a tenth of a second.
TASK_BYTES = 4 << 20


class Piece(NamedTuple):
    """The bytes from ``start`` to ``stop`` of a file."""

    path: str
    split: int
    start: int
    stop: int


class Pieces(InputPartition):
    """Pieces that one task reads."""

    def __init__(self, pieces: list[Piece]):
        super().__init__(None)
        self.pieces = pieces


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[str, int]]:
    """The files at ``path``, a file or a folder (names that begin with . or _ are passed over), and
    their sizes."""
    system, name = opened(path)
    found = system.get_file_info(name)
    if found.type == fs.FileType.NotFound:
        raise FileNotFoundError(f"no page files at {path}")
    infos = [found] if found.type == fs.FileType.File else [i for i in system.get_file_info(fs.FileSelector(name, recursive=True)) if i.type == fs.FileType.File and not any(part[:1] in "._" for part in i.path[len(name) :].split("/") if part)]
    if not infos:
        raise FileNotFoundError(f"no page files at {path}")
    for info in infos:
        if info.size == 0:
            raise ValueError(f"a file without pages: {info.path}")
    return sorted((i.path, i.size) for i in infos)


def pages_of(system: fs.FileSystem, piece: Piece) -> Iterator[bytes]:
    """The pages that begin in a piece, in order."""
    # little beyond the piece is read: its last page may end there
    size = min(BLOCK, max(piece.stop - piece.start, 1 << 12))
    with system.open_input_file(piece.path) as file:
        at = max(piece.start - 1, 0)
        file.seek(at)
        held, begins = b"", piece.start == 0
        while True:
            block = file.read(size)
            parts = (held + block).split(BREAK)
            if block:
                held = parts.pop()
            elif not parts[-1]:
                parts.pop()  # nothing behind the last break
            for page in parts:
                if begins:
                    if at >= piece.stop:
                        return
                    yield page
                begins = True
                at += len(page) + 1
            if not block or (begins and at >= piece.stop):
                return


class PageReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.bytes = int(options.get("splitbytes", SPLIT_BYTES))
        self.count = options.get("count", "false").lower() == "true"

    def partitions(self) -> list[Pieces]:
        tasks: list[Pieces] = []
        held = TASK_BYTES
        for path, size in listed(self.path):
            for k, start in enumerate(range(0, size, self.bytes)):
                piece = Piece(path, k, start, min(start + self.bytes, size))
                if held + piece.stop - start > TASK_BYTES:
                    tasks.append(Pieces([]))
                    held = 0
                tasks[-1].pieces.append(piece)
                held += piece.stop - start
        return tasks

    def read(self, task: Pieces) -> Iterator[pa.RecordBatch]:
        system, _ = opened(self.path)
        if self.count:
            counts = [sum(1 for _ in pages_of(system, piece)) for piece in task.pieces]
            yield pa.RecordBatch.from_pydict({"path": [p.path for p in task.pieces], "split": pa.array([p.split for p in task.pieces], pa.int64()), "pages": pa.array(counts, pa.int64())})
            return
        for piece in task.pieces:
            texts: list[str] = []
            done = 0
            for page in pages_of(system, piece):
                texts.append(page.decode())
                if len(texts) >= BATCH:
                    yield self.batch(piece, done, texts)
                    done, texts = done + len(texts), []
            if texts:
                yield self.batch(piece, done, texts)

    @staticmethod
    def batch(piece: Piece, done: int, texts: list[str]) -> pa.RecordBatch:
        n = len(texts)
        return pa.RecordBatch.from_pydict({"path": [piece.path] * n, "split": pa.array([piece.split] * n, pa.int64()), "nth": pa.array(range(done, done + n), pa.int64()), "text": pa.array(texts, pa.string())})


class PageFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "page_files"

    def schema(self) -> str:
        return "path string, split long, pages long" if self.options.get("count", "false").lower() == "true" else "path string, split long, nth long, text string"

    def reader(self, schema) -> PageReader:
        return PageReader(dict(self.options))


def read_pages(spark: SparkSession, path: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pages of the files at ``path``: (path, page_num from 0, text, word_count)."""
    spark.dataSource.register(PageFiles)
    source = spark.read.format("page_files").option("splitBytes", split_bytes)
    before = F.sum("pages").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    # a row for each split
    offsets = source.option("count", True).load(path).select("path", "split", F.coalesce(before, F.lit(0)).alias("before"))
    pages = source.option("count", False).load(path).join(offsets, ["path", "split"])
    return pages.select("path", (F.col("before") + F.col("nth")).cast("int").alias("page_num"), "text", F.size(words("text")).alias("word_count"))


def write_pages(pages: DataFrame, path: str, file: str, *order: str) -> None:
    """Write ``text`` of ``pages`` as page files, one for each value of the column ``file``, pages in
    the given order. Form feeds within a page become blanks. Spark's text writer does the writing."""
    rows = pages.repartition(file).sortWithinPartitions(file, *order)
    rows.select(file, F.translate(F.coalesce("text", F.lit("")), "\f", " ").alias("value")).write.partitionBy(file).option("lineSep", "\f").text(path)
