"""Connected components of an edge table, by alternating stars.

Each round lets every node hand its smallest neighbour on: first to its larger neighbours, then to its
smaller ones. Both steps are a min per node (combined before the shuffle) and a join, so that a hub with
very many edges costs one row a neighbour. Rounds needed grow with the logarithm of the longest chain.
Nothing is collected but the number of edges and a checksum, which show when a round changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkweave.operators.scratch import Scratch


def connected_components(edges: DataFrame, scratch: Scratch, max_rounds: int = 60) -> DataFrame:
    """node, component (its smallest member) of all nodes that have an edge to another node.

    ``edges``: columns a, b of one ordered type, in any direction; nulls and loops don't count. Tables go
    to ``scratch``; those of a round go once the next one is written.
    """
    e = edges.where(F.col("a") != F.col("b")).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e, before = scratch.cut(e), None
    for _ in range(max_rounds):
        now = tuple(e.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == before or not now[0]:
            break
        before = now
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written out, so that both sides of the join are plain shuffles and a hub's rows can be split
        m = scratch.cut(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        large = both.join(m, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        old, e = e, scratch.cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        scratch.drop(old)
        scratch.drop(m)
    else:
        raise RuntimeError(f"components did not settle within {max_rounds} rounds")
    nodes = e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return nodes.unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
