"""Connected components of an edge table by alternating star contraction, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def _to_smallest(edges: DataFrame, larger_only: bool) -> DataFrame:
    """Point neighbours of every node at the smallest node of its neighbourhood.

    With larger_only the larger neighbours move (large star); else edges are first
    turned to lead from larger to smaller, and all of those move (small star).
    """
    if larger_only:
        near = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).union(edges.select("b", "a"))
    else:
        near = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    moved = near.join(least, "u")
    if larger_only:
        moved = moved.where(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        moved = moved.select(F.col("v").alias("a"), F.col("m").alias("b")).union(least.select("u", "m"))
    return moved.where(F.col("a") != F.col("b")).distinct()


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(node, component) for every node with an edge; component is the smallest node reachable.

    edges has two columns of one orderable type, in any direction, with repeats and
    loops allowed; rows with a null are left out. Nodes without an edge to another
    node give no row. An empty table gives an empty result. Work per round is two
    aggregations and two joins on the node, which Spark splits where a node is hot;
    no group is gathered. Each round is a table in the shared folder.
    """
    a, b = edges.columns[:2]
    plain = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).where("a is not null and b is not null and a <> b")
    now = stored(plain.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    for _ in range(max_rounds):
        after = stored(_to_smallest(_to_smallest(now, True), False), "edges")
        # The rounds end at stars, which a further round leaves as they are.
        sums = [t.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first() for t in (now, after)]
        discard(now)
        now = after
        if sums[0] == sums[1]:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())
