"""Prefix trie of conversations, by blocks of turns.

A node is a distinct sequence of first turns (role, text); its members are the conversations
that begin with it. Turns are 128-bit digests seeded by their place, so the digest of a prefix is
the exclusive or of its turns' and any part of a conversation can be summed by itself.

1. Turns are numbered by ranges of (conv_id, turn): a conversation may span many tasks.
2. Prefixes: within segments of ``SEGMENT`` turns a running sum, before them the sum of the
   segments. No task gets more of a conversation than a segment, or a row for each segment.
3. Blocks of ``BLOCK`` turns are grouped by the digests of their prefixes; copies become one
   block with the count and the least id of its conversations before their turns are looked at.
   Where a prefix is followed by one block only, the block's turns are nodes as they stand. Only
   where sibling blocks diverge are their turns' boundaries refined, by prefix.
4. What a subtree holds is added up by doubling: in round k every shared node gives what is
   known of the 2^k levels below and with it to the ancestor 2^k above. Nodes of one
   conversation are known at once, so rounds run over shared nodes, in number the logarithm of
   their depth. An ancestor is found by (least member, depth), which no two nodes share.
5. The ids that end at a node are joined in runs of ids, and the runs hashed in order.

Turns are ordered by turn, nulls first; those of one turn by role, then by text's digest. Null
role and text count as empty. Texts of any length count whole. Repeated rows are repeated turns.
Rows with a null conv_id belong to no conversation. A conv_id is an integer; other types are
refused. A table without rows has no nodes, not even a root. Extra columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quoin.llm.common import WORD, read, written

BLOCK, SEGMENT = 4, 1024
#: Conversation ids that may meet in a row when ends are joined.
RUN_IDS = 65_536
#: Tasks that the children of one node are dealt to where they meet it.
SALTS = 16
HEAD, EVERY = 3, 20


def shared_turns(conv: str = "conv_id") -> Column:
    """How many first turns a conversation takes from the one that its id leads to."""
    return (F.crc32(F.col(conv).cast("string").cast("binary")) % (HEAD + 1)).cast("int")


def digested(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, a, b, words): a and b tell role and text apart."""
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    turns = rows.where("conv_id IS NOT NULL").select(F.col("conv_id").cast("long"), "turn", role.alias("role"), text.alias("_text"))
    return turns.select("conv_id", "turn", "role", F.xxhash64("role", "_text").alias("a"), F.xxhash64(F.lit(7), "_text", "role").alias("b"), F.regexp_count("_text", F.lit(WORD)).cast("long").alias("words"))


def numbered(turns: DataFrame) -> DataFrame:
    """``turns`` with ``pos``, from 1 within a conversation. Ranges of (conv_id, turn) are dealt to
    tasks; conversations that span tasks take the counts of earlier ones, at most two a task."""
    order = [F.col("conv_id"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("a"), F.col("b")]
    # a number written down with the rows parts those that are equal
    rows = written(turns.withColumn("tie", F.monotonically_increasing_id()))
    dealt = written(rows.repartitionByRange(*order, F.col("tie")).withColumn("part", F.spark_partition_id()))
    counts = dealt.groupBy("conv_id", "part").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("conv_id", "part", F.sum("n").over(earlier).alias("before")).where("before IS NOT NULL")
    own = F.row_number().over(Window.partitionBy("conv_id", "part").orderBy(*order[1:], "tie"))
    placed = dealt.withColumn("own", own).join(offsets, ["conv_id", "part"], "left")
    return placed.select("conv_id", (F.col("own") + F.coalesce("before", F.lit(0))).cast("long").alias("pos"), "a", "b", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Conversations (conv_id) and their turns (conv_id, i, a, b, words) after each has taken the
    first turns of the conversation that begins its group of ids."""
    lengths = turns.groupBy("conv_id").agg(F.max("pos").alias("n"))
    convs = lengths.select("conv_id", "n", shared_turns().alias("h"), (F.col("conv_id") - F.pmod("conv_id", F.lit(EVERY))).alias("base"))
    bases = lengths.where(F.pmod("conv_id", F.lit(EVERY)) == 0).select(F.col("conv_id").alias("base"), F.least("n", F.lit(HEAD)).alias("has"))
    convs = written(convs.join(bases, "base", "left").withColumn("taken", F.least("h", F.coalesce("has", F.lit(0)))))
    heads = turns.where((F.col("pos") <= HEAD) & (F.pmod("conv_id", F.lit(EVERY)) == 0)).select(F.col("conv_id").alias("base"), F.col("pos").alias("i"), "a", "b", "words")
    taken = convs.select("conv_id", "base", "taken").join(heads, "base").where("i <= taken").select("conv_id", "i", "a", "b", "words")
    # a row for each segment of a conversation, so that a long one meets its shift in many tasks
    shifts = convs.select("conv_id", (F.col("taken") - F.col("h")).alias("shift"), F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / SEGMENT))).alias("seg"))
    own = turns.where(F.col("pos") > shared_turns()).withColumn("seg", F.floor((F.col("pos") - 1) / SEGMENT))
    moved = own.join(shifts, ["conv_id", "seg"]).select("conv_id", (F.col("pos") + F.col("shift")).alias("i"), "a", "b", "words")
    return convs.select("conv_id"), taken.union(moved)


def prefixes(turns: DataFrame) -> DataFrame:
    """``turns`` (conv_id, i, words) with the digests of the prefix up to them (x, y) and of the
    one before (px, py)."""
    rows = turns.select("conv_id", "i", "words", F.floor((F.col("i") - 1) / SEGMENT).alias("seg"), F.xxhash64("i", "a", "b").alias("u"), F.xxhash64("b", "i", "a").alias("v"))
    sums = rows.groupBy("conv_id", "seg").agg(F.bit_xor("u").alias("u"), F.bit_xor("v").alias("v"))
    earlier = Window.partitionBy("conv_id").orderBy("seg").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("conv_id", "seg", *(F.coalesce(F.bit_xor(c).over(earlier), F.lit(0)).alias(f"{c}0") for c in ("u", "v")))
    upto = Window.partitionBy("conv_id", "seg").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    run = rows.withColumns({"ru": F.bit_xor("u").over(upto), "rv": F.bit_xor("v").over(upto)}).join(before, ["conv_id", "seg"])
    x, y = F.col("ru").bitwiseXOR(F.col("u0")), F.col("rv").bitwiseXOR(F.col("v0"))
    return run.select("conv_id", "i", "words", x.alias("x"), y.alias("y"), x.bitwiseXOR(F.col("u")).alias("px"), y.bitwiseXOR(F.col("v")).alias("py"))


def salted(rows: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """``rows`` joined with ``side``, which has a row for a key: rows of one key go to ``SALTS``
    tasks, where copies of the side's row meet them."""
    salt = F.pmod(F.xxhash64("x", "y"), F.lit(SALTS)).cast("int")
    copies = side.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", salt).join(copies, [*keys, "_salt"], how).drop("_salt")


def nodes(paths: DataFrame) -> DataFrame:
    """(x, y, px, py, depth, words, n_convs, conv_id) of all nodes but the root."""
    turn = F.struct("i", "x", "y", "px", "py", "words")
    of_conv = paths.groupBy("conv_id", F.floor((F.col("i") - 1) / BLOCK).alias("k")).agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    # the digest of its last prefix names a block and all before it; copies become one
    last = F.element_at("turns", -1)
    groups = of_conv.select("conv_id", "turns", last["x"].alias("x"), last["y"].alias("y")).groupBy("x", "y", F.size("turns").alias("size"))
    blocks = written(groups.agg(F.first("turns").alias("turns"), F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).withColumns({"sx": F.col("turns")[0]["px"], "sy": F.col("turns")[0]["py"]}))
    parting = blocks.groupBy("sx", "sy").agg(F.count("*").alias("kinds")).where("kinds > 1")
    met = salted(blocks, parting, ["sx", "sy"], "left").select("kinds", "n_convs", "conv_id", F.explode("turns").alias("t")).select("kinds", "n_convs", "conv_id", "t.*")
    columns = ["x", "y", "px", "py", F.col("i").alias("depth"), "words", "n_convs", "conv_id"]
    alone = met.where("kinds IS NULL").select(*columns)
    refined = met.where("kinds IS NOT NULL").groupBy("x", "y", "px", "py", "i", "words").agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"))
    return alone.union(refined.select(*columns))


def ends(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """(x, y, ends_sha256) of the nodes at which conversations end."""
    last = paths.groupBy("conv_id").agg(F.max_by(F.struct("x", "y"), "i").alias("at"))
    at = convs.join(last, "conv_id", "left").select("conv_id", F.coalesce("at.x", F.lit(0)).alias("x"), F.coalesce("at.y", F.lit(0)).alias("y"))
    ids = F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string"))
    runs = at.groupBy("x", "y", F.expr(f"conv_id div {RUN_IDS}").alias("run")).agg(F.min("conv_id").alias("first"), F.array_join(ids, ",").alias("ids"))

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for batch in batches:
            out = []
            for x, y, text in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2))):
                if (x, y) == now:
                    digest.update(b"," + text.encode())
                    continue
                if now is not None:
                    out.append((*now, digest.hexdigest()))
                now, digest = (x, y), hashlib.sha256(text.encode())
            yield rows_of(out)
        if now is not None:
            yield rows_of([(*now, digest.hexdigest())])

    def rows_of(out: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([r[k] for r in out], kind) for k, kind in enumerate((pa.int64(), pa.int64(), pa.string()))]
        return pa.RecordBatch.from_arrays(columns, names=["x", "y", "ends_sha256"])

    ordered = runs.repartition("x", "y").sortWithinPartitions("x", "y", "first").select("x", "y", "ids")
    return ordered.mapInArrow(hashed, "x long, y long, ends_sha256 string")


def subtree_sums(shared: DataFrame, paths: DataFrame) -> DataFrame:
    """(x, y, leaves, saved) of nodes (x, y, conv_id, depth, leaves, saved), each with the sums of
    all nodes below it. ``paths`` (conv_id, i, x, y) finds ancestors."""
    deepest = shared.agg(F.max("depth")).first()[0]
    step = 1
    while deepest is not None and step <= deepest:
        gives = shared.where(F.col("depth") >= step).select("conv_id", (F.col("depth") - step).alias("i"), "leaves", "saved")
        up = gives.join(paths, ["conv_id", "i"], "left")  # depth 0 has no turn: the root is (0, 0)
        given = up.groupBy(F.coalesce("x", F.lit(0)).alias("x"), F.coalesce("y", F.lit(0)).alias("y")).agg(F.sum("leaves").alias("_l"), F.sum("saved").alias("_s"))
        more = shared.join(given, ["x", "y"], "left")
        shared = written(more.select("x", "y", "conv_id", "depth", *((F.col(c) + F.coalesce(g, F.lit(0))).alias(c) for c, g in (("leaves", "_l"), ("saved", "_s")))))
        step *= 2
    return shared.select("x", "y", "leaves", "saved")


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes: conv_id (least member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256."""
    if conversations.schema["conv_id"].dataType.typeName() not in ("byte", "short", "integer", "long"):
        raise TypeError(f"conv_id is {conversations.schema['conv_id'].dataType.simpleString()}, not an integer")
    convs, turns = rebuilt(written(numbered(digested(conversations))))
    paths = written(prefixes(turns))
    zero = lambda name: F.lit(0).cast("long").alias(name)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).where("n_convs > 0")
    root = root.select(zero("x"), zero("y"), F.lit(None).cast("long").alias("px"), F.lit(None).cast("long").alias("py"), zero("depth"), zero("words"), "n_convs", "conv_id")
    found = written(nodes(paths).union(root))
    child = F.count_if(F.col("n_convs") == 1).alias("n_single")
    children = found.where("px IS NOT NULL").groupBy(F.col("px").alias("x"), F.col("py").alias("y")).agg(F.count("*").alias("n_children"), child)
    rows = found.join(children, ["x", "y"], "left").join(ends(convs, paths), ["x", "y"], "left").fillna(0, ["n_children", "n_single"])
    rows = written(rows)
    # below a node of one conversation lies one leaf and nothing is saved
    leaves = F.when(F.col("n_children") == 0, 1).otherwise(F.col("n_single"))
    shared = rows.where("n_convs > 1").select("x", "y", "conv_id", "depth", leaves.cast("long").alias("leaves"), ((F.col("n_convs") - 1) * F.col("words")).alias("saved"))
    sums = subtree_sums(written(shared), paths.select("conv_id", "i", "x", "y"))
    parents = rows.where("n_children > 0").select(F.col("x").alias("px"), F.col("y").alias("py"), F.col("conv_id").alias("parent_conv_id"))
    named = salted(rows, parents, ["px", "py"], "left").join(sums, ["x", "y"], "left")
    return named.select(
        "conv_id",
        "depth",
        "parent_conv_id",
        "n_convs",
        "n_children",
        F.coalesce("leaves", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("saved", F.lit(0)).cast("long").alias("saved_tokens"),
        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All nodes of the trie over the conversations."""
    return trie(read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))


#: Bits of the unsigned crc32 of a conversation's id, found byte by byte, bit by bit.
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
    lambda s, c: list_reduce(list_prepend(xor(s, c), [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda v, z: xor(v // 2, (v % 2) * 3988292384))))"""
OP13_SQL = rf"""
WITH own AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos,
    sha256(coalesce(role, '') || chr(10) || coalesce(text, '')) AS t, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), conv AS (
  SELECT conv_id, ({_CRC} % 4)::INT AS h, list({{'t': t, 'w': words}} ORDER BY pos) AS ts FROM own GROUP BY conv_id
), made AS (
  SELECT c.conv_id, list_concat(coalesce(b.ts[1 : c.h], []), c.ts[c.h + 1 :]) AS ts FROM conv c LEFT JOIN conv b ON b.conv_id = c.conv_id - c.conv_id % 20
), step AS (
  SELECT conv_id, unnest(range(len(ts) + 1)) AS depth, ts FROM made
), prefix AS (
  SELECT conv_id, depth, depth = len(ts) AS at_end, CASE WHEN depth > 0 THEN ts[depth].w ELSE 0 END AS words,
    sha256(array_to_string(list_transform(ts[1 : depth], lambda x: x.t), ',')) AS k, CASE WHEN depth > 0 THEN sha256(array_to_string(list_transform(ts[1 : depth - 1], lambda x: x.t), ',')) END AS parent
  FROM step
), node AS (
  SELECT k, depth, any_value(parent) AS parent, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (at_end), '')) AS ends_sha256 FROM prefix GROUP BY k, depth
), child AS (
  SELECT parent AS k, count(*) AS n_children FROM node WHERE depth > 0 GROUP BY parent
), full_ AS (
  SELECT n.*, coalesce(n_children, 0) AS n_children FROM node n LEFT JOIN child USING (k)
), below AS (
  SELECT p.k, sum(CASE WHEN f.n_children = 0 THEN 1 ELSE 0 END) AS n_leaves, sum((f.n_convs - 1) * f.words) AS saved_tokens
  FROM full_ f JOIN prefix p ON p.conv_id = f.conv_id AND p.depth <= f.depth GROUP BY p.k
)
SELECT f.conv_id, f.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, f.n_convs, f.n_children::BIGINT AS n_children, n_leaves::BIGINT AS n_leaves, saved_tokens::BIGINT AS saved_tokens, f.ends_sha256
FROM full_ f JOIN below USING (k) LEFT JOIN node p ON p.k = f.parent
"""
