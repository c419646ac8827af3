"""Connected components of an edge list by alternating large and small stars, all in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import checkpointed


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*"), F.sum((F.xxhash64("u", "v") % 1_000_003).cast("long"))).first()
    return row[0], row[1] or 0


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of `edges` (u, v: bigint) other than the roots: root is the smallest node that can be reached.

    Each round is a large and a small star; their number grows with the logarithm of the longest path. Between rounds the edges, at most one for
    each node and round, are checkpointed; nothing but two numbers reaches the driver. Self-loops and nulls are ignored; an empty list has no rows.
    """
    now = checkpointed(edges.select("u", "v").where("u != v").distinct())
    state = _state(now)
    for _ in range(max_rounds):
        if not state[0]:
            break
        now = checkpointed(_small_star(_large_star(now)))
        before, state = state, _state(now)
        if before == state:
            break
    else:
        raise RuntimeError(f"components: not settled after {max_rounds} rounds")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
