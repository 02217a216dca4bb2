"""URL filter over a memory-mapped sorted digest array.

Entries (host, path, verdict) are stored as strings host + path in files: their sorted 64-bit
xxhash keys, an offset each, and the strings; beside them the sorted keys of the hosts with the
path lengths that each host's entries have. A URL's candidates are its host and each parent
domain, each with the path cut to those lengths; hosts and candidates are found by one
vectorised binary search a batch, and a hit counts only if the stored string is the candidate's.
The longest entry wins, a rule before a listed address of any length. A URL that meets no entry
is allowed.

The rules are a short list of the caller's. The listed addresses may be a list or a table; a
table of any size is dealt into slices of about ``SLICE_ENTRIES`` entries by the hash of the
host, each of which the driver writes as a file and Spark ships once to every executor, where
all workers map it.

A host ends at the first ``/``, ``?`` or ``#`` behind ``://`` and is lower-cased (A-Z); the
path goes on to ``?`` or ``#``. Null urls and those without ``://`` have neither, match
nothing and are allowed; urls of any length are judged whole. Entries that are null count as
empty strings, repeated ones once. Repeated rows are judged alike, and a table without rows
gives none. Extra columns are carried along, except those named as results.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import guarded, mapped, read, shipped

SLICE_ENTRIES = 1_000_000
#: The seed of Spark's own xxhash64, and what of it deals entries out.
SEED, LOW = 42, (1 << 63) - 1
#: The rules (host, path, verdict).
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]
#: Second-level names that stand for unwanted kinds of hosts, under each of the test domains.
LISTED = [f"{name}.example.{top}" for name in ("ads-track", "adult-x", "casino-win", "cheap-pills", "free-bets", "spam-farm") for top in ("com", "net", "org")]

KINDS = ["allow", "block"]


def key(octets: bytes) -> int:
    return xxhash.xxh64_intdigest(octets, SEED)


def arrays(entries: Iterable[tuple[str, str, str, bool]]) -> dict[str, np.ndarray]:
    """The arrays of one slice of entries (host, path, verdict, is a rule)."""
    known = dict.fromkeys(entries)
    rows = sorted((key((host + path).encode()), (host + path).encode(), KINDS.index(verdict), rule) for host, path, verdict, rule in known)
    lengths: dict[int, set[int]] = {}
    for host, path, *_ in known:
        lengths.setdefault(key(host.encode()), set()).add(len(path))
    hosts = sorted(lengths)
    return {
        "keys": np.array([r[0] for r in rows], np.uint64),
        "ends": np.cumsum([0, *(len(r[1]) for r in rows)], dtype=np.int64),
        "flags": np.array([r[2] * 2 + r[3] for r in rows], np.uint8),
        "text": np.frombuffer(b"".join(r[1] for r in rows), np.uint8),
        "hosts": np.array(hosts, np.uint64),
        "host_ends": np.cumsum([0, *(len(lengths[h]) for h in hosts)], dtype=np.int64),
        "lengths": np.array([n for h in hosts for n in sorted(lengths[h])], np.int32),
    }


class Digests:
    """One slice, over the arrays of ``arrays``."""

    def __init__(self, of: dict[str, np.ndarray]):
        self.__dict__.update(of)

    def string(self, k: int) -> bytes:
        return self.text[self.ends[k] : self.ends[k + 1]].tobytes()

    def path_lengths(self, hosts: np.ndarray) -> list[list[int]]:
        """The path lengths of the entries of each host key; none for an unknown host."""
        at = np.minimum(np.searchsorted(self.hosts, hosts), max(len(self.hosts) - 1, 0))
        out: list[list[int]] = [[] for _ in hosts]
        for i in np.flatnonzero(self.hosts[at] == hosts) if len(self.hosts) else ():
            out[i] = self.lengths[self.host_ends[at[i]] : self.host_ends[at[i] + 1]].tolist()
        return out

    def probe(self, candidates: list[bytes]) -> np.ndarray:
        """The entry of each candidate, or -1. Entries of equal keys are tried one by one."""
        found = np.fromiter(map(key, candidates), np.uint64, len(candidates))
        at = np.searchsorted(self.keys, found)
        out = np.full(len(found), -1, np.int64)
        for i in np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == found) if len(self.keys) else ():
            k = int(at[i])
            while k < len(self.keys) and self.keys[k] == found[i]:
                if self.string(k) == candidates[i]:
                    out[i] = max(out[i], k)  # of equal strings the last: block after allow, a rule after a listed one
                k += 1
        return out


def verdicts(slices: list[Digests], hosts: list[str], paths: list[str]) -> Iterator[tuple[str | None, str]]:
    """Rule, or none, and verdict of each url."""
    names, owner = [], []
    for i, host in enumerate(hosts):
        labels = host.split(".") if host else []
        names += [".".join(labels[j:]).encode() for j in range(len(labels))]
        owner += [i] * len(labels)
    keys = np.fromiter(map(key, names), np.uint64, len(names))
    of = (keys & np.uint64(LOW)) % np.uint64(len(slices))
    best: dict[int, tuple[tuple, str | None]] = {}
    for s, digests in enumerate(slices):
        mine = np.flatnonzero(of == s)
        probes, whose = [], []
        for m, lengths in zip(mine.tolist(), digests.path_lengths(keys[mine])):
            path = paths[owner[m]]
            cut = [names[m] + path[:n].encode() for n in lengths if n <= len(path)]
            probes += cut
            whose += [owner[m]] * len(cut)
        for i, k in zip(whose, digests.probe(probes).tolist()):
            if k >= 0:
                flag, text = int(digests.flags[k]), digests.string(k)
                found = ((flag & 1, len(text), flag), text.decode() if flag & 1 else None)
                best[i] = max(best.get(i, found), found, key=lambda x: x[0])
    for i in range(len(hosts)):
        rank, rule = best.get(i, ((0, 0, 0), None))
        yield rule, KINDS[rank[2] >> 1]


def entry_table(spark: SparkSession, rules: list[tuple[str, str, str]], listed: DataFrame | list[str]) -> DataFrame:
    """(host, path, verdict, rule) of the rules and of what is listed: a list of hosts to block,
    or a table with the columns host, path and verdict."""
    schema = "host string, path string, verdict string, rule boolean"
    if not isinstance(listed, DataFrame):
        return spark.createDataFrame([(*r, True) for r in rules] + [(host, "", "block", False) for host in listed], schema)
    empty = lambda c: F.coalesce(c, F.lit("")).alias(c)
    return spark.createDataFrame([(*r, True) for r in rules], schema).union(listed.select(empty("host"), empty("path"), "verdict", F.lit(False).alias("rule")))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], listed: DataFrame | list[str], url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null without one) and verdict (allow or block)."""
    spark = pages.sparkSession
    table = entry_table(spark, rules, listed)
    slices = max(1, -(-table.count() // SLICE_ENTRIES))
    dealt = F.xxhash64("host").bitwiseAND(F.lit(LOW)) % slices
    names = [shipped(spark, arrays(tuple(r) for r in table.where(dealt == k).collect())) for k in range(slices)]

    rest = F.when(F.instr(url, "://") > 0, F.expr(f"substring(`{url}`, instr(`{url}`, '://') + 3)"))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    own, back = guarded(pages, ["host", "path", "rule", "verdict"])
    keep = [f"_c{i}" for i in range(len(own))]
    frame = pages.select(*own, F.coalesce(host, F.lit("")).alias("host"), F.coalesce(path, F.lit("")).alias("path"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        digests = [Digests(mapped(SparkFiles.get(name))) for name in names]
        for batch in batches:
            found = list(verdicts(digests, *(batch.column(len(keep) + i).to_pylist() for i in range(2))))
            rule, verdict = (pa.array([x[i] for x in found], pa.string()) for i in range(2))
            yield pa.RecordBatch.from_arrays([*batch.columns, rule, verdict], names=[*keep, "host", "path", "rule", "verdict"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in frame.schema)
    judged = frame.mapInArrow(run, f"{types}, rule string, verdict string")
    return judged.select(*back, "host", "path", "rule", "verdict")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page's url."""
    rows = judge(read(spark, sf_dir, "pages").select("page_id", "url"), RULES, LISTED)
    return rows.select("page_id", "host", "path", "rule", "verdict")


OP6_SQL = """
WITH p AS (
  SELECT page_id, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), h AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM p
), r(rhost, rpath, verdict) AS (
  VALUES ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'allow'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')
), m AS (
  SELECT page_id, arg_max(rhost || rpath, length(rhost || rpath)) AS rule, arg_max(verdict, length(rhost || rpath)) AS verdict
  FROM h JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath) GROUP BY page_id
), l(lhost) AS (
  VALUES """ + ", ".join(f"('{x}')" for x in LISTED) + """
)
SELECT page_id, host, path, m.rule,
  coalesce(m.verdict, CASE WHEN EXISTS (SELECT 1 FROM l WHERE host = lhost OR ends_with(host, '.' || lhost)) THEN 'block' ELSE 'allow' END) AS verdict
FROM h LEFT JOIN m USING (page_id)
"""
