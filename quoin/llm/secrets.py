"""Secret scan with multipart credential linking.

A first pass over the whole texts finds parts: spans with a role (access identifier, secret,
endpoint) that are strong by themselves or weak. Strong spans are always reported. A weak
span is reported only where the parts that complete it lie near by, in the same scope of the
same text: an access identifier beside a secret, a secret beside an access identifier, an
endpoint beside both. "Near" is an interval join: with ``gaps`` at most ``reach`` code points lie between
the two spans, however long they are, else between their starts. Parts are dealt into all buckets of ``reach`` code points
that they touch, each bucket keeps for every role its first start and last end, and a weak span
looks into the buckets from ``reach`` before its start to ``reach`` behind its end. No pairs of
parts are made, however many stand in one bucket. A scope ends at a blank line.

Null and empty texts have no spans and are still returned, each with empty results; a table
without rows gives none. Texts are read whole. Repeated rows, also such of one doc_id, are judged row by row. Columns other than
``doc_id`` and ``text`` are carried along by ``scan`` unless they bear a name of its results.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import per_text, read, text_or_empty
from quoin.session import cut

# The strong patterns and the least lengths of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # AKIA[A-Z0-9]+ of 20 or more
HEX = re.compile(r"[0-9a-f]{24,}")

#: What counts only in company: names that introduce an identifier, a secret, an endpoint.
WEAK = [
    ("weak_access", "access", re.compile(r"""\b(?:user(?:name)?|login|account|client_?id|key_?id|access_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9@+/_.-]{3,}""", re.IGNORECASE | re.ASCII)),
    ("weak_secret", "secret", re.compile(r"""\b(?:pass|pwd|pw|key|credentials?|auth|signature|bearer)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{6,}""", re.IGNORECASE | re.ASCII)),
    ("endpoint", "endpoint", re.compile(r"""\b(?:[a-z][a-z0-9+.-]{1,15}://[^\s"'<>]{4,}|(?:host|server|endpoint|url)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.:/-]{4,})""", re.IGNORECASE | re.ASCII)),
]
KINDS = ["assign", "access", "hex", *(kind for kind, _, _ in WEAK)]
ROLES = {"assign": "secret", "access": "access", "hex": "secret", **{kind: role for kind, role, _ in WEAK}}
BLANK = re.compile(r"\n[ \t\r]*\n")


def strong_spans(text: str) -> list[tuple[str, int, int]]:
    found = []
    if "=" in text or ":" in text:
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    return found + [("hex", *m.span()) for m in HEX.finditer(text)]


def weak_spans(text: str, strong: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """Weak spans that touch no strong one."""
    if "=" not in text and ":" not in text:
        return []
    taken = sorted((start, end) for _, start, end in strong)
    ends: list[int] = []
    for _, end in taken:
        ends.append(max(end, ends[-1] if ends else 0))
    out = []
    for kind, _, pattern in WEAK:
        for m in pattern.finditer(text):
            k = bisect_left(taken, (m.end(),))  # those before k start before this one's end
            if k == 0 or ends[k - 1] <= m.start():
                out.append((kind, *m.span()))
    return out


def parts(text: str) -> list[tuple]:
    """A row for each part; one row without a kind stands for the text itself."""
    strong = strong_spans(text)
    spans = strong + weak_spans(text, strong)
    breaks = [m.start() for m in BLANK.finditer(text)] if spans else []
    return [(None, None, None, None), *((kind, start, end, bisect_left(breaks, start)) for kind, start, end in spans)]


def scan(docs: DataFrame, text: str = "text", reach: int = 300, gaps: bool = False) -> DataFrame:
    """A row per row of ``docs``: its other columns and ``spans``, an array of
    (start, kind_no, kind, end), sorted, with places in code points, ends exclusive."""
    keep = [c for c in docs.columns if c not in (text, "spans")]
    named = {c: f"_c{i}" for i, c in enumerate(keep)}
    frame = docs.select(*(F.col(f"`{c}`").alias(k) for c, k in named.items()), F.monotonically_increasing_id().alias("_row"), text_or_empty(text).alias("_text"))
    fields = [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("scope", pa.int32())]
    found = cut(per_text(frame, "_text", lambda: parts, fields, "kind string, start int, end int, scope int", many=True))

    role = F.create_map(*(F.lit(x) for pair in ROLES.items() for x in pair))[F.col("kind")]
    spans = found.where("kind IS NOT NULL").select("_row", "kind", "start", "end", "scope", role.alias("role"))
    stop = "end" if gaps else "start"
    buckets = lambda first, last: F.explode(F.sequence(F.floor(first / reach).cast("int"), F.floor(last / reach).cast("int")))
    places = spans.withColumn("bucket", buckets(F.col("start"), F.col(stop))).groupBy("_row", "scope", "bucket", F.col("role").alias("beside")).agg(F.min("start").alias("first"), F.max(stop).alias("last"))
    weak = spans.where(F.col("kind").isin([kind for kind, _, _ in WEAK])).withColumn("bucket", buckets(F.col("start") - reach, F.col(stop) + reach))
    near = weak.join(places, ["_row", "scope", "bucket"]).where((F.col("beside") != F.col("role")) & (F.col("last") >= F.col("start") - reach) & (F.col("first") <= F.col(stop) + reach))
    have = near.groupBy("_row", "kind", "start", "end", "role").agg(F.collect_set("beside").alias("with"))
    both = F.array_contains("with", "access") & F.array_contains("with", "secret")
    linked = have.where(
        F.when(F.col("role") == "access", F.array_contains("with", "secret")).when(F.col("role") == "secret", F.array_contains("with", "access")).otherwise(both)
    ).select("_row", "kind", "start", "end")

    base = found.where("kind IS NULL OR kind IN ('assign', 'access', 'hex')")
    rows = base.select("_row", *named.values(), "kind", "start", "end").unionByName(linked, allowMissingColumns=True)
    number = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int").alias("kind_no")
    span = F.when(F.col("kind").isNotNull(), F.struct("start", number, "kind", "end"))
    # the row without a kind alone carries the columns of the text
    carried = [F.max_by(F.struct(*named.values()), F.col("kind").isNull()).alias("_own")] if named else []
    grouped = rows.groupBy("_row").agg(*carried, F.array_sort(F.collect_list(span)).alias("spans"))
    return grouped.select(*(F.col(f"_own.{k}").alias(c) for c, k in named.items()), "spans")


def listed(spans):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(read(spark, sf_dir, "documents").select("doc_id", "text"), gaps=True)
    base = F.filter("spans", lambda s: s["kind_no"] <= 3)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
