"""Connected components by alternating stars, in DataFrame operations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablestore.llm.common import checkpoint


def connected(edges: DataFrame, rows: int | None = None) -> DataFrame:
    """(node, root) for every node of the edges (u, v): root is the smallest node of its component.

    Large and small stars alternate until the edges no longer change; each round is checkpointed. The number of
    edges never grows beyond the input's nodes and edges, and the rounds grow with the logarithm of the longest path.
    The least neighbours are checkpointed too: both sides of a join are then plain shuffles, and Spark can split
    a hub's edges. Loops and repeated edges do no harm. `rows`: about how many distinct edges there are at most.
    """
    now = checkpoint(edges.where("u != v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), rows)
    mark = None
    while True:
        found = now.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first()
        if found == mark or not found[0]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        mark = found
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = checkpoint(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), 2 * found[0])
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        least = checkpoint(large.groupBy("u").agg(F.min("v").alias("m")), 2 * found[0])
        small = large.join(least, "u").where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = checkpoint(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), 2 * found[0])
