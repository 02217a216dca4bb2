"""Near duplicates by HyperMinHash.

A document's set are its distinct shingles of ``words`` words (ASCII capitals lowered), as
64-bit hashes. A sketch has ``BUCKETS`` registers; each holds, of the least hash in its
bucket, the number of leading zeros and the ``MANTISSA`` bits behind the leading one. Empty
buckets borrow from others by a fixed sequence of probes, so short texts have full sketches.

1. Rows with equal sets collapse to one node, so copies never meet in pairs.
2. Bands of registers are hashed; nodes with an equal band hang on the least of them (a star,
   not pairs), and the components of these stars are the candidate clusters: every candidate
   pair lies in one.
3. Clusters are dealt out in blocks, by their ids alone, before the sets of clustered nodes are
   made. A group is a cluster, or of a large one a block and two hubs. Groups go to tasks by
   cluster and block, so a large cluster is spread over all of them. A task estimates the Jaccard
   similarity of a group's pairs from the registers, corrected for chance collisions, and
   confirms on the full sets those that may reach the threshold and are not yet connected. It
   returns links, fewer than it has nodes.
4. In large clusters, nodes outside the largest component so far are then held, in blocks,
   against all nodes of their cluster, so no block boundary costs a link.

A pair at the threshold is missed by all bands with a chance of about 5e-6. The estimate's cut
stands four standard errors below the threshold, with the error of as many registers as the smaller
set has filled, so of short texts every pair that meets is confirmed on the full sets.

Null and empty texts have an empty set and are linked with nothing. A text of fewer words
than a shingle is one shingle. Rows with a null doc_id are linked with nothing; their
component is null; ``dedup`` keeps them. Rows of one doc_id with unlike sets are one node with
several sets. A doc_id is an integer; other types are refused. Extra columns are not read by
``groups``; ``dedup`` carries them along. Texts of any length are read whole; a table without rows
gives none.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.llm.common import per_text, read, text_or_empty, written
from quoin.llm.components import components

BUCKET_BITS, MANTISSA = 8, 10
BUCKETS = 1 << BUCKET_BITS
BAND_ROWS, BANDS = 6, 42
#: Nodes that one task compares; a larger cluster is dealt out in blocks of about half.
CLUSTER_NODES = 1_000
#: Tasks that the ids of one cluster are dealt to where they meet what is known of it.
SALTS = 64
PROBES = 64
CACHED_WORDS = 200_000

K1, K2, K3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
S27, S30, S31 = np.uint64(27), np.uint64(30), np.uint64(31)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> S30)) * K2
    x = (x ^ (x >> S27)) * K3
    return x ^ (x >> S31)


PROBE = (mixed(np.arange(PROBES * BUCKETS, dtype=np.uint64) * K1) % np.uint64(BUCKETS)).astype(np.int64).reshape(PROBES, BUCKETS)


class WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= CACHED_WORDS:
            self.clear()
        value = self[word] = xxhash.xxh64_intdigest(word)
        return value


def shingle_set(text: str, words: int, known: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles."""
    tokens = text.encode().lower().split()  # bytes: ASCII capitals, the six blanks
    if not tokens:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    size = min(words, len(tokens))
    x = np.full(len(h) - size + 1, size, np.uint64)
    for k in range(size):
        x = mixed(x * K1 + h[k : len(h) - size + 1 + k])
    return np.unique(x)


def sketch(hashes: np.ndarray) -> np.ndarray:
    """The registers of a set that is not empty."""
    bucket = (hashes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    width = 64 - BUCKET_BITS
    rest = hashes[first] & np.uint64((1 << width) - 1)
    length = np.frexp(rest.astype(np.float64))[1].astype(np.int64)
    shift = length - 1 - MANTISSA
    bits = np.where(shift >= 0, rest >> np.maximum(shift, 0).astype(np.uint64), rest << np.maximum(-shift, 0).astype(np.uint64))
    out, have = np.zeros(BUCKETS, np.uint16), np.zeros(BUCKETS, bool)
    out[bucket[first]] = ((width - length) << MANTISSA | (bits & np.uint64((1 << MANTISSA) - 1)).astype(np.int64)).astype(np.uint16)
    have[bucket[first]] = True
    lack = np.flatnonzero(~have)
    for t in range(PROBES):
        if not lack.size:
            return out
        source = PROBE[t, lack]
        found = have[source]
        out[lack[found]] = out[source[found]]
        lack = lack[~found]
    if lack.size:
        full = np.flatnonzero(have)
        out[lack] = out[full[np.searchsorted(full, lack) % full.size]]
    return out


def band_keys(registers: np.ndarray) -> np.ndarray:
    rows = registers[: BANDS * BAND_ROWS].reshape(BANDS, BAND_ROWS).astype(np.uint64)
    x = np.arange(BANDS, dtype=np.uint64)
    for k in range(BAND_ROWS):
        x = mixed(x * K1 + rows[:, k])
    return x.view(np.int64)


#: Chance that registers of different least hashes agree, for sets of like size.
COLLISION = 0.17 / (1 << MANTISSA)


def estimates(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Jaccard similarity of a sketch and others, less the collisions to be expected."""
    share = (many == one).mean(axis=1)
    return (share - COLLISION) / (1 - COLLISION)


def least(filled: np.ndarray, percent: int) -> np.ndarray:
    """The estimate from which a pair may reach ``percent``. Empty buckets borrow, so an estimate is
    worth as many registers as the smaller sketch has filled itself, and where that are few, also
    how often each is borrowed varies: their variance counts twice."""
    p = percent / 100
    return p - 4 * np.sqrt((1 + (filled < BUCKETS)) * p * (1 - p) / np.maximum(filled, 1))


def linked(sets: list[np.ndarray], labels: list, query: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Confirmed links between nodes of unlike labels that join what was not joined yet. Every
    pair with a query node that may reach ``percent`` is estimated."""
    n = len(sets)
    registers = np.stack([sketch(s) for s in sets])
    sizes = np.array([len(s) for s in sets])
    parent = list(range(n))

    def find(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    first: dict = {}
    for i, label in enumerate(labels):
        parent[i] = find(first.setdefault(label, i))
    filled = np.array([len(np.unique(s >> np.uint64(64 - BUCKET_BITS))) for s in sets])
    left, right, score = [], [], []
    for i in np.flatnonzero(query):
        other = np.arange(n) > i if query.all() else ~query | (np.arange(n) > i)
        other &= (100 * np.minimum(sizes, sizes[i]) >= percent * np.maximum(sizes, sizes[i]))
        j = np.flatnonzero(other)
        e = estimates(registers[i], registers[j])
        may = e >= least(np.minimum(filled[i], filled[j]), percent)
        j, e = j[may], e[may]
        left.append(np.full(len(j), i))
        right.append(j)
        score.append(e)
    if not left:
        return []
    left, right, score = np.concatenate(left), np.concatenate(right), np.concatenate(score)
    out = []
    for k in np.argsort(-score, kind="stable"):
        a, b = int(left[k]), int(right[k])
        x, y = find(a), find(b)
        if x == y:
            continue
        s, t = (sets[a], sets[b]) if len(sets[a]) <= len(sets[b]) else (sets[b], sets[a])
        at = np.searchsorted(t, s)
        common = int((t[np.minimum(at, len(t) - 1)] == s).sum())
        if 100 * common >= percent * (len(s) + len(t) - common):
            parent[x] = y
            out.append((a, b))
    return out


def sketched(docs: DataFrame, text: str, words: int) -> DataFrame:
    """(doc_id, n_shingles, digest, bands): digest names the set, null for an empty one."""
    fields = [("n_shingles", pa.int64()), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))]

    def make():
        known = WordHashes()

        def one(value: str) -> tuple:
            found = shingle_set(value, words, known)
            if not len(found):
                return 0, None, None
            return len(found), xxhash.xxh3_128_digest(found.tobytes()), band_keys(sketch(found))

        return one

    return per_text(docs.select("doc_id", text_or_empty(text).alias("_text")), "_text", make, fields, "n_shingles long, digest binary, bands array<long>")


def told(nodes: DataFrame, side: DataFrame, how: str) -> DataFrame:
    """``nodes`` (cluster, node and more) joined with ``side``, a row for some clusters. A large
    cluster's nodes are dealt to ``SALTS`` tasks, as its one row is copied to them."""
    salted = nodes.withColumn("salt", F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int"))
    copies = side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return salted.join(copies, ["cluster", "salt"], how).drop("salt")


def dealt_out(clusters: DataFrame) -> DataFrame:
    """(node, cluster) with the number of blocks of the cluster and the node's blocks: one, or
    all of them for the two hubs of a large cluster."""
    hashed = F.struct(F.xxhash64("node"), "node")
    sizes = clusters.groupBy("cluster").agg(F.count("*").alias("n"), F.min(hashed).alias("hub1"), F.max(hashed).alias("hub2")).where(F.col("n") > CLUSTER_NODES)
    large = sizes.select("cluster", F.ceil(F.col("n") / (CLUSTER_NODES // 2)).cast("int").alias("blocks"), F.array("hub1.node", "hub2.node").alias("hubs"))
    own = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).when(F.array_contains("hubs", F.col("node")), F.expr("sequence(0, blocks - 1)")).otherwise(F.array(F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")))
    return told(clusters, large, "left").select("node", "cluster", F.coalesce("blocks", F.lit(1)).alias("blocks"), own.alias("own"))


def node_sets(docs: DataFrame, text: str, words: int, wanted: DataFrame) -> DataFrame:
    """``wanted`` (node and more) with its sets, made anew from the texts; a node is a doc_id."""
    rows = docs.select(F.col("doc_id").alias("node"), text_or_empty(text).alias("_text")).join(wanted, "node")

    def make():
        known = WordHashes()
        return lambda value: (shingle_set(value, words, known).tobytes(),)

    made = per_text(rows.select(*wanted.columns, "_text"), "_text", make, [("hashes", pa.binary())], "hashes binary")
    return made.where(F.length("hashes") > 0)


def links(rows: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) of rows (keys, node, label, query, hashes), each group of keys in a task:
    every label that was joined to others, and the least of them."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["node", "query"], ascending=[True, False]).drop_duplicates(["node", "hashes"])
        labels = pdf["label"].tolist()
        pairs = linked([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], labels, pdf["query"].to_numpy(bool), percent)
        root = {x: x for x in labels}

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for i, j in pairs:
            x, y = find(labels[i]), find(labels[j])
            root[max(x, y)] = min(x, y)
        joined = [x for x in root if find(x) != x]
        return pd.DataFrame({"a": joined, "b": [find(x) for x in joined]}, dtype="int64")

    # else an exchange by the cluster alone, made for a join, would serve the groups, all blocks in one task
    dealt = rows.select(*keys, "node", "label", "query", "hashes").repartition(*keys)
    return dealt.groupBy(*keys).applyInPandas(one, "a long, b long")


def cluster_links(sets: DataFrame, percent: int) -> DataFrame:
    """All links of the clusters in ``sets`` (node, cluster, blocks, own, hashes), as a spanning set."""
    half = CLUSTER_NODES // 2
    dealt = sets.withColumn("block", F.explode("own"))
    found = written(links(dealt.withColumns({"label": F.col("node"), "query": F.lit(True)}), ["cluster", "block"], percent))
    rest = sets.where("blocks > 1")
    if rest.limit(1).count() == 0:
        return found
    named = rest.select("cluster", "node").distinct().join(components(found).withColumnRenamed("root", "label"), "node", "left").select("cluster", "node", F.coalesce("label", "node").alias("label"))
    labelled = written(named)
    by_label = labelled.groupBy("cluster", "label").agg(F.count("*").alias("m"))
    # the largest component of a cluster has no queries: a link to it has one at its other end
    chief = by_label.groupBy("cluster").agg(F.max_by("label", F.struct("m", "label")).alias("chief"), F.sum("m").alias("all"), F.max("m").alias("most"))
    asked = rest.select("node", "hashes").join(told(labelled, chief.where("most < all"), "inner"), "node")
    query = F.col("label") != F.col("chief")
    q_blocks, t_blocks = F.ceil((F.col("all") - F.col("most")) / half).cast("int"), F.ceil(F.col("all") / half).cast("int")
    spread = asked.select("cluster", "node", "hashes", "label", query.alias("is_query"), q_blocks.alias("qs"), t_blocks.alias("ts"), F.xxhash64("node").alias("h"))
    as_query = spread.where("is_query").select("cluster", "node", "hashes", "label", F.lit(True).alias("query"), F.expr("cast(pmod(h, qs) AS int)").alias("qb"), F.explode(F.expr("sequence(0, ts - 1)")).alias("tb"))
    as_target = spread.select("cluster", "node", "hashes", "label", F.lit(False).alias("query"), F.explode(F.expr("sequence(0, qs - 1)")).alias("qb"), F.expr("cast(pmod(h, ts) AS int)").alias("tb"))
    return found.union(written(links(as_query.union(as_target), ["cluster", "qb", "tb"], percent)))


def groups(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of ``docs``."""
    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"doc_id is {docs.schema['doc_id'].dataType.simpleString()}, not an integer")
    docs = docs.select("doc_id", text)
    rows = written(sketched(docs, text, words))
    sets = rows.where("doc_id IS NOT NULL AND digest IS NOT NULL")
    # a node is named by the least doc_id of its set
    nodes = sets.groupBy("digest").agg(F.min("doc_id").alias("node"), F.first("bands").alias("bands"))
    keys = nodes.select("node", F.explode("bands").alias("key"))
    stars = keys.groupBy("key").agg(F.min("node").alias("b"), F.count("*").alias("n")).where("n > 1").select("key", "b")
    clusters = components(keys.join(stars, "key").select(F.col("node").alias("a"), "b")).select("node", F.col("root").alias("cluster"))
    roots = components(cluster_links(written(node_sets(docs, text, words, dealt_out(clusters))), percent))
    ids = sets.groupBy("digest").agg(F.min("doc_id").alias("node")).join(roots, "node", "left")
    of_set = ids.select("digest", F.coalesce("root", "node").alias("component_id"))
    named = rows.select("doc_id", "n_shingles", "digest").join(of_set, "digest", "left")
    return named.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id"))


def dedup(docs: DataFrame, text: str = "text", words: int = 5, percent: int = 80) -> DataFrame:
    """The rows of ``docs`` whose doc_id is the least of their group; rows without one too."""
    first = groups(docs, text, words, percent).where("component_id = doc_id").select("doc_id").distinct()
    return docs.join(first, "doc_id", "left_semi").union(docs.where("doc_id IS NULL"))


def op9_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = groups(read(spark, sf_dir, "documents").select("doc_id", "text"), words=2, percent=80)
    return found.withColumn("kept", F.col("doc_id") == F.col("component_id"))


OP9_SQL = r"""
WITH RECURSIVE worded AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents
), shingled AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) = 1 THEN w ELSE list_distinct([w[i] || ' ' || w[i + 1] FOR i IN range(1, len(w))]) END AS s FROM worded
), sized AS (
  SELECT doc_id, len(s)::BIGINT AS n_shingles, s FROM shingled
), item AS (
  SELECT doc_id, n_shingles, unnest(s) AS x FROM sized
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM item a JOIN item b ON a.x = b.x AND a.doc_id <> b.doc_id
    AND 100 * least(a.n_shingles, b.n_shingles) >= 80 * greatest(a.n_shingles, b.n_shingles)
  GROUP BY a.doc_id, b.doc_id, a.n_shingles, b.n_shingles
  HAVING 100 * count(*) >= 80 * (a.n_shingles + b.n_shingles - count(*))
), reach(a, b) AS (
  SELECT doc_id, doc_id FROM documents
  UNION
  SELECT r.a, p.b FROM reach r JOIN pair p ON p.a = r.b
), least AS (
  SELECT a AS doc_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT doc_id, n_shingles, component_id, doc_id = component_id AS kept FROM sized JOIN least USING (doc_id)
"""
