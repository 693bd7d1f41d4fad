"""Connected components of an edge table, by alternating large-star and small-star steps.

Nothing is collected but two numbers a round. Every round is written to the shared
folder, so that a lost executor costs one round at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftwell.llm.common import materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Point neighbours of each node at the least of them (the node included)."""
    both = edges.select("u", "v")
    both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else both
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("least"))
    joined = both.join(least, "u")
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("least").alias("v"))
    else:
        out = joined.where("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v")).unionByName(least.where("u <> least").select("u", F.col("least").alias("v")))
    return out.where("u <> v").distinct()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, root)`` for every node of ``edges(u long, v long)``; root is the least node reachable.

    Loops and repeated edges are ignored. No edges give no rows. Nulls are ignored.
    """
    ordered = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, before = materialise(ordered, "edges"), None
    for _ in range(rounds):
        count = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
        if count == before:
            break
        before = count
        if not count["n"]:
            break
        now = materialise(_star(_star(now, True), False), "edges")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select("v").distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots.select(F.col("v").alias("node"), F.col("v").alias("root")))
