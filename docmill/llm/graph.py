"""Connected components over an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docmill.llm.common import materialize


#: A node with more than one of 2^12 of the rows of a step is a hot one. A step has twice the edges at most.
HOT_SHARE = 1 << 12


def connected_components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps (Kiveris et al. 2014), each a groupBy and a join, until nothing changes; that takes
    O(log^2 n) rounds. Every step is written to the shared folder. Edges from a node to itself and repeated ones are fine.
    The edges of a hot node don't meet in one task: these nodes, fewer than 2^12, are broadcast with their least neighbours.
    """

    def star(pairs: DataFrame, large: bool, total: int) -> DataFrame:
        both = pairs.union(pairs.select("b", "a")) if large else pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"), F.count(F.lit(1)).alias("n"))
        many = F.col("n") * HOT_SHARE > 2 * total
        hot, rare = low.where(many).select("a", "low"), low.where(~many).select("a", "low")
        joined = both.join(F.broadcast(hot), "a").union(both.join(rare, "a"))
        if large:
            out = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("low").alias("b"))
        else:
            out = joined.select(F.col("b").alias("a"), F.col("low").alias("b")).union(low.select("a", F.col("low").alias("b")))
        return out.where("a <> b").distinct()

    def state(pairs: DataFrame) -> tuple:
        return tuple(pairs.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())

    pairs = materialize(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    was = state(pairs)
    for _ in range(most_rounds):
        if not was[0]:
            break
        pairs = materialize(star(pairs, True, was[0]), "large-stars")
        pairs = materialize(star(pairs, False, was[0]), "stars")
        if (now := state(pairs)) == was:
            break
        was = now
    else:
        raise RuntimeError(f"components have not settled after {most_rounds} rounds")
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("root")).union(pairs.select("b", "b").distinct())
