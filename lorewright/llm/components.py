"""Connected components by alternating large-star and small-star rounds over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lorewright.llm.shared import drop, written


def _large_star(edges: DataFrame) -> DataFrame:
    """Every neighbour above a node moves to the smallest of the node and its neighbours."""
    both = edges.select("a", "b").unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours move to the smallest of these; edges come as a > b."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    moved = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionAll(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def connected_components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; component is the smallest node reachable.

    edges has long columns a and b; direction, self-loops and repeats don't matter. No edges: no rows. Each round is a
    written table, so a lost executor costs one round. So are the edges before the first, as a round names its edges eight times
    and whatever they come from would stand in its plan as often. Rounds needed grow with the logarithm of the nodes.
    """
    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = written(edges, "components")
    state = None
    for _ in range(rounds):
        before, edges = edges, written(_small_star(_large_star(edges)), "components")
        drop(before)
        now = edges.agg(F.count("*").alias("n"), F.coalesce(F.bit_xor(F.xxhash64("a", "b")), F.lit(0)).alias("x")).first()
        if now == state:
            break
        state = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(roots)
    out._lorewright_path = edges._lorewright_path
    return out
