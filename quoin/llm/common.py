"""Small things that several operators of this subpackage share."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.session import shared_folder

#: Words end at these six characters only.
WORD = r"[^\x20\x09-\x0D]+"


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def written(df: DataFrame, **options: str) -> DataFrame:
    """``df`` as a compressed table in the shared folder, reread: cuts lineage and serves
    several readers that want different columns. ``options`` are the Parquet writer's."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/quoin-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Folders of shipped files on the driver; they go when the driver's Python ends.
_SHIPPED: list[tempfile.TemporaryDirectory] = []


def shipped(spark: SparkSession, arrays: dict[str, np.ndarray]) -> str:
    """Give every executor a file of arrays, once, and return the name for ``mapped``. Spark
    serves the file from the driver; tasks find it with ``SparkFiles``."""
    folder = tempfile.TemporaryDirectory(prefix="quoin-")
    _SHIPPED.append(folder)
    name = f"quoin-{uuid.uuid4().hex}"
    stored(arrays, os.path.join(folder.name, name))
    spark.sparkContext.addFile(os.path.join(folder.name, name))
    return name


def stored(arrays: dict[str, np.ndarray], path: str) -> None:
    """Arrays behind a line that states name, type, length and place of each."""
    told, at = [], 0
    for name, x in arrays.items():
        told.append((name, x.dtype.str, len(x), at))
        at += -(-x.nbytes // 8) * 8
    head = json.dumps(told).encode()
    with open(path, "wb") as file:
        file.write(head + b" " * (-(len(head) + 1) % 8) + b"\n")
        for x in arrays.values():
            file.write(x.tobytes() + bytes(-x.nbytes % 8))


def mapped(path: str) -> dict[str, np.ndarray]:
    """The arrays of a stored file, memory-mapped: workers of a node share its pages."""
    with open(path, "rb") as file:
        head = file.readline()
    return {name: np.memmap(path, kind, "r", len(head) + at, (n,)) if n else np.empty(0, kind) for name, kind, n, at in json.loads(head)}


def gathered(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of ``flat`` one behind the other, and their sizes."""
    before = np.cumsum(sizes) - sizes
    return flat[np.arange(sizes.sum()) + np.repeat(starts - before, sizes)], sizes


def text_or_empty(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))


def guarded(df: DataFrame, but: Iterable[str]) -> tuple[list, list]:
    """Columns of ``df`` other than ``but``: under names that clash with nothing, and back."""
    keep = [c for c in df.columns if c not in set(but)]
    return [F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(keep)], [F.col(f"_c{i}").alias(c) for i, c in enumerate(keep)]


def per_text(
    df: DataFrame,
    column: str,
    make: Callable[[], Callable[[str], tuple | Iterable[tuple]]],
    fields: list[tuple[str, pa.DataType]],
    schema: str,
    many: bool = False,
    step_chars: int = 1_000_000,
    together: bool = False,
) -> DataFrame:
    """Apply a small per-text function to a string column, in Arrow batches.

    ``make()`` runs once in each task and returns the function. It gets a text (null as
    empty) and returns the new columns' values, or with ``many`` several such rows. The
    other columns of ``df`` are repeated beside them; ``column`` itself is not returned. With
    ``together`` it gets a list of texts and returns a row for each.
    Results leave the task whenever about ``step_chars`` characters have been read, so a
    batch of very long texts is never held with all its results.
    """
    rest = [c for c in df.columns if c != column]
    frame = df.select(*rest, column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        function = make()
        for batch in batches:
            texts = batch.column(len(rest))
            others = pa.Table.from_batches([batch]).select(list(range(len(rest))))
            rows, at, seen = [], [], 0
            for i in range(len(texts)):
                text = texts[i].as_py() or ""
                got = text if together else function(text)
                if many:
                    for row in got:
                        rows.append(row)
                        at.append(i)
                else:
                    rows.append(got)
                    at.append(i)
                seen += len(text)
                if seen >= step_chars or i + 1 == len(texts):
                    if together:
                        rows = function(rows)
                    if rows:
                        columns = [c.combine_chunks() if c.num_chunks else pa.array([], c.type) for c in others.take(pa.array(at, pa.int64())).columns]
                        columns = [c.chunk(0) if isinstance(c, pa.ChunkedArray) else c for c in columns]
                        columns += [pa.array(values, kind) for values, (_, kind) in zip(zip(*rows), fields, strict=True)]
                        yield pa.RecordBatch.from_arrays(columns, names=rest + [name for name, _ in fields])
                    rows, at, seen = [], [], 0

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema if f.name != column)
    return frame.mapInArrow(run, f"{types}, {schema}" if types else schema)
