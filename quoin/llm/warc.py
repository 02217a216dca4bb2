"""WARC archives and the merged index of their captures.

``write`` turns captures into WARC records and writes them as text files whose line separator
is the empty line pair that ends a record, so Spark's own writer makes the archives. Every
archive is a run sorted by URL key, time and capture id. Equal payloads are found by digest and
length: the smallest capture id is the response, the others become revisit records that name
it. ``read`` takes the archives record by record, by their stated lengths, and checks each
payload against its digest; what a task has read it merges, ``MERGE_ROWS`` captures at most, to
a longer run. ``merged_index`` orders all captures: ranges of URL key, time and id are dealt to
tasks, and a task merges the runs' pieces. Both merges are loser trees.

An archive has at most ``FILE_ROWS`` records and no more than one writing task holds, which
adaptive execution sizes by bytes. It is compressed as one file, not record by record. A reader
holds its compressed bytes, which end at 2 GB, one record at a time beside them, and no more
than the index rows of a run. A single payload may have up to 2 GB.

Null html counts as an empty payload, a null url or time as an empty one. Captures without an id are
written but never a response for others. Repeated rows (same id, same payload) are one
response and no revisit of itself: both are responses. Columns beside the four that ``write``
names are not read. A table without rows makes archives without records, and an index without
rows. Hot payloads shrink to one row a task before the shuffle, and the join back is split by
adaptive execution. Hot URLs are dealt to many ranges, because the time takes part in the order.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import read as read_table
from quoin.llm.common import written
from quoin.session import shared_folder

EMPTY_LINE = "\r\n"
STAMP = "yyyy-MM-dd'T'HH:mm:ss'Z'"
BETWEEN = "\r\n\r\n"
#: The alphabets of base 32, Java's and the standard's.
DIGITS, BASE32 = "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
#: What stands before a payload in a response's block.
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: Captures in an archive at most.
FILE_ROWS = 20_000
#: Index rows that a run or a merging task is meant to hold.
MERGE_ROWS = 100_000


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 SHA-1: 40 hexadecimal digits are eight groups of 20 bits."""
    digest = F.sha1(payload)
    groups = [F.lpad(F.conv(F.substring(digest, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.lower(F.concat(*groups)), DIGITS, BASE32)


def deduplicated(captures: DataFrame, least_bytes: int = 0) -> DataFrame:
    """``captures`` (capture_id, url, time, payload) with payload_bytes, payload_digest,
    record_type and refers_to."""
    rows = captures.select(
        "capture_id", "time", F.coalesce("url", F.lit("")).alias("url"), F.coalesce("payload", F.lit("")).alias("payload")
    ).withColumns({"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": base32_sha1(F.col("payload").cast("binary"))})
    first = (
        rows.where(F.col("payload_bytes") >= least_bytes)
        .groupBy("payload_digest", "payload_bytes")
        .agg(F.min("capture_id").alias("first"), F.count("*").alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    found = rows.join(first, ["payload_digest", "payload_bytes"], "left")
    again = F.col("first").isNotNull() & ~F.col("first").eqNullSafe(F.col("capture_id"))
    return found.withColumns({"record_type": F.when(again, "revisit").otherwise("response"), "refers_to": F.when(again, F.col("first"))}).drop("first")


def record(row_type: str = "record_type") -> Column:
    """The text of a WARC record without the separator that ends it. A response's block is an
    HTTP head and the payload; a revisit's is empty and states the payload's length apart."""
    response = F.col(row_type) == "response"
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(EMPTY_LINE))
    number = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    return F.concat(
        F.lit("WARC/1.1" + EMPTY_LINE),
        line("WARC-Type", F.col(row_type)),
        line("WARC-Record-ID", F.concat(F.lit("<urn:capture:"), number("capture_id"), F.lit(">"))),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Date", F.coalesce(F.date_format("time", STAMP), F.lit(""))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        F.when(response, F.lit("")).otherwise(
            F.concat(line("WARC-Refers-To", F.concat(F.lit("<urn:capture:"), number("refers_to"), F.lit(">"))), line("X-Payload-Length", number("payload_bytes")))
        ),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", F.when(response, (F.col("payload_bytes") + len(HTTP)).cast("string")).otherwise(F.lit("0"))),
        F.lit(EMPTY_LINE),
        F.when(response, F.concat(F.lit(HTTP), F.col("payload"))).otherwise(F.lit("")),
    )


def key_of(url: str) -> Column:
    """``url_key`` as an expression, by which the archives are sorted."""
    behind = F.expr(f"substring({url}, instr({url}, '://') + 3)")
    bare = F.when((F.instr(url, "://") > 0) & (behind != ""), behind).otherwise(F.col(url))
    rest = F.lower(F.substring_index(bare, "#", 1))
    host = F.regexp_replace(F.substring_index(F.substring_index(rest, "/", 1), ":", 1), r"^www\.", "")
    path = F.when(F.instr(rest, "/") > 0, F.concat(F.lit("/"), F.regexp_replace(rest, r"(?s)^[^/]*/", ""))).otherwise("")
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), ","), F.lit(")"), path)


def write(captures: DataFrame, path: str, least_bytes: int = 0) -> None:
    """Archives of ``captures`` (capture_id, url, time, payload) under ``path``."""
    rows = deduplicated(captures, least_bytes).withColumn("url", F.regexp_replace("url", r"[\r\n]", ""))
    out = rows.select(record().alias("value"), key_of("url").alias("key"), F.coalesce(F.date_format("time", STAMP), F.lit("")).alias("stamp"), "capture_id")
    runs = out.sortWithinPartitions("key", "stamp", F.asc_nulls_first("capture_id")).select("value")
    runs.write.option("lineSep", BETWEEN).option("maxRecordsPerFile", FILE_ROWS).option("compression", "gzip").text(path)


def parse(file: io.BufferedIOBase) -> Iterator[tuple[dict[bytes, bytes], bytes]]:
    """Header fields and block of each record, in the file's order."""
    while first := file.readline():
        if not first.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {first[:40]!r}")
        fields = {}
        while line := file.readline().rstrip(b"\r\n"):
            name, _, value = line.partition(b": ")
            fields[name] = value
        yield fields, file.read(int(fields[b"Content-Length"]))
        file.read(len(BETWEEN))


def url_key(url: str) -> str:
    """Sort key of a URL: host labels from the top one down, then path and query, lower case."""
    _, _, rest = url.partition("://")
    rest = (rest or url).partition("#")[0].lower()
    host, slash, path = rest.partition("/")
    labels = host.partition(":")[0].removeprefix("www.").split(".")
    return ",".join(reversed(labels)) + ")" + slash + path


READ_SCHEMA = "capture_id long, url string, url_key string, time string, payload_bytes long, payload_digest string, record_type string, refers_to long, run string, place int"


def capture(fields: dict[bytes, bytes], block: bytes) -> tuple:
    """The index row of a record, without its run and place."""
    number = lambda value: int(value[len(b"<urn:capture:") : -1] or -1) if value else None
    response = fields[b"WARC-Type"] != b"revisit"
    payload = memoryview(block)[block.find(EMPTY_LINE.encode() * 2) + 4 :] if response else memoryview(b"")
    digest = fields[b"WARC-Payload-Digest"].removeprefix(b"sha1:")
    if response and base64.b32encode(hashlib.sha1(payload).digest()) != digest:
        raise ValueError(f"{fields[b'WARC-Record-ID']!r}: a payload differs from its digest")
    url, own = fields[b"WARC-Target-URI"].decode(), number(fields[b"WARC-Record-ID"])
    size = len(payload) if response else int(fields[b"X-Payload-Length"])
    return (None if own == -1 else own, url, url_key(url), fields[b"WARC-Date"].decode(), size, digest.decode(), "response" if response else "revisit", number(fields.get(b"WARC-Refers-To")))


def in_order(rows: list[tuple], by) -> list[tuple]:
    """The rows sorted; those of an archive written here are sorted already."""
    keys = [by(row) for row in rows]
    return rows if all(map(lambda a, b: a <= b, keys, keys[1:])) else sorted(rows, key=by)


def read(spark: SparkSession, path: str) -> DataFrame:
    """A row for each record under ``path``, its payload checked against its digest. ``run``
    names a sorted run, that of one archive or of several merged, ``place`` the rank there."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, size, name = [], 0, None
        for batch in batches:
            for i in range(batch.num_rows):
                content = batch.column(1)[i].as_buffer()
                file = io.BufferedReader(pa.BufferReader(content))
                if file.peek(2)[:2] == b"\x1f\x8b":
                    file = gzip.GzipFile(fileobj=file)
                rows = in_order([capture(*found) for found in parse(file)], order)
                if runs and size + len(rows) > MERGE_ROWS:
                    yield from merged(runs, name)
                    runs, size = [], 0
                runs, size, name = [*runs, rows], size + len(rows), batch.column(0)[i].as_py()
        yield from merged(runs, name)

    def merged(runs: list[list[tuple]], name: str) -> Iterator[pa.RecordBatch]:
        yield from batches_of((*row, name, i) for i, row in enumerate(LoserTree([iter(run) for run in runs], order)))

    return files.mapInArrow(records, READ_SCHEMA)


READ_NAMES = [field.split(" ")[0] for field in READ_SCHEMA.split(", ")]
READ_TYPES = [{"long": pa.int64(), "string": pa.string(), "int": pa.int32()}[field.split(" ")[1]] for field in READ_SCHEMA.split(", ")]


def order(row: tuple) -> tuple:
    """URL key, time, capture id (none first)."""
    return row[2], row[3], -1 if row[0] is None else row[0]


class LoserTree:
    """Merges sorted runs: inner nodes hold the loser of their match, the winner goes up."""

    def __init__(self, runs: list[Iterator[tuple]], key):
        self.runs, self.key = runs, key
        self.heads = [next(run, None) for run in runs]
        self.keys = [None if x is None else (key(x), i) for i, x in enumerate(self.heads)]
        n = self.size = max(1, len(runs))
        self.losers = [-1] * n
        winners = [-1] * n + list(range(len(runs)))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            first, second = (a, b) if self.before(a, b) else (b, a)
            winners[node], self.losers[node] = first, second
        self.winner = winners[1] if len(runs) > 1 else 0

    def before(self, a: int, b: int) -> bool:
        x, y = self.keys[a], self.keys[b]
        return x is not None and (y is None or x < y)

    def __iter__(self) -> Iterator[tuple]:
        while self.runs and self.keys[self.winner] is not None:
            i = self.winner
            yield self.heads[i]
            self.heads[i] = x = next(self.runs[i], None)
            self.keys[i] = None if x is None else (self.key(x), i)
            node = (i + self.size) // 2
            while node:
                if self.before(self.losers[node], i):
                    self.losers[node], i = i, self.losers[node]
                node //= 2
            self.winner = i


def merged_index(captures: DataFrame, total: int) -> DataFrame:
    """``captures`` as ``read`` gives them, in one order by URL key, time and id: ``part`` is the
    range, in order, and ``position`` the place in it. ``total`` is their number, from which
    the number of ranges follows, so that a task holds about ``MERGE_ROWS`` index rows."""
    ranges = max(1, -(-total // MERGE_ROWS))
    dealt = captures.repartitionByRange(ranges, "url_key", "time", "capture_id").withColumn("part", F.spark_partition_id())
    schema = f"{READ_SCHEMA}, part int, position long"

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces: dict[str, list[tuple]] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                pieces.setdefault(row[8], []).append(row)
        # a run's rows come in its order, but for those that two tasks have read
        runs = [iter(in_order(piece, lambda row: row[9])) for _, piece in sorted(pieces.items())]
        yield from batches_of((*row, position) for position, row in enumerate(LoserTree(runs, order)))

    return dealt.mapInArrow(merge, schema)


def histories(index: DataFrame) -> DataFrame:
    """A merged index with ``rank``, the place in the whole order, from 1. Only the ranges'
    row counts, one number for each ``MERGE_ROWS`` rows, meet in one task."""
    index = written(index)
    sizes = index.groupBy("part").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return index.join(sizes.select("part", before.alias("before")), "part").withColumn("rank", F.col("before") + F.col("position") + 1).drop("before", "part", "position")


def batches_of(rows: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
    """Index rows, with part and position where they have them, as Arrow batches."""
    while some := list(islice(rows, 10_000)):
        kinds = [*READ_TYPES, pa.int32(), pa.int64()][: len(some[0])]
        yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*some), kinds)], names=[*READ_NAMES, "part", "position"][: len(kinds)])


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back, in the merged index's order."""
    pages = read_table(spark, sf_dir, "pages")
    captured = F.timestamp_seconds(F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    path = f"{shared_folder(spark)}/quoin-warc-{uuid.uuid4().hex}"
    write(pages.select(F.col("page_id").alias("capture_id"), "url", captured.alias("time"), F.col("html").alias("payload")), path)
    rows = written(read(spark, path))
    index = histories(merged_index(rows, rows.count()))
    return index.select(F.col("capture_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "time", "rank")


OP3_SQL = """
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html FROM pages
), d AS (
  SELECT page_id, url, octet_length(encode(html))::BIGINT AS payload_bytes, sha1(html) AS hex,
    CASE WHEN contains(url, '://') AND substr(url, strpos(url, '://') + 3) <> '' THEN substr(url, strpos(url, '://') + 3) ELSE url END AS bare
  FROM p
), e AS (
  SELECT *, lower(split_part(bare, '#', 1)) AS rest,
    array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((('0x' || substr(hex, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1) FOR i IN range(32)], '') AS payload_digest
  FROM d
), f AS (
  SELECT *, split_part(split_part(rest, '/', 1), ':', 1) AS host, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first FROM e
), g AS (
  SELECT page_id, payload_bytes, payload_digest,
    CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
    CASE WHEN first <> page_id THEN first END AS refers_to,
    array_to_string(list_reverse(string_split(CASE WHEN starts_with(host, 'www.') THEN substr(host, 5) ELSE host END, '.')), ',') || ')'
      || CASE WHEN contains(rest, '/') THEN substr(rest, strpos(rest, '/')) ELSE '' END AS url_key,
    strftime(to_timestamp(1700000000 + page_id) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS time
  FROM f
)
SELECT *, row_number() OVER (ORDER BY url_key, time, page_id) AS rank FROM g
"""
