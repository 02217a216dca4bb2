"""Connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.session import cut

#: Edges that a task of a round is meant to hold; rounds over few edges have few tasks.
TASK_EDGES = 200_000


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    """One star step over edges (a, b) with b < a. Large: every greater neighbour of a node is
    tied to the node's least neighbour. Small: every lesser one, and the node, likewise."""
    if large:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select(F.col("b"), F.col("a")))
    else:
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
    met = both.join(least, "u").coalesce(tasks)
    if large:
        out = met.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = met.select(F.explode(F.array(F.struct(F.col("v").alias("a"), F.col("m").alias("b")), F.struct(F.col("u").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
    return out.where("a <> b").distinct().coalesce(tasks)


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b): root is the least node reachable.

    Stops when a round leaves the edges as they were. A node with any number of neighbours is
    aggregated before the shuffle and its join is split by adaptive execution."""
    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        sign = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("s")).first()
        if sign == seen:
            break
        seen = sign
        tasks = 1 + sign.n // TASK_EDGES
        now = cut(_star(_star(now.coalesce(tasks), True, tasks), False, tasks))
    roots = now.select(F.col("b").alias("root")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("root", "root"))
