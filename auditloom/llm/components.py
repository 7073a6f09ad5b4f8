"""Connected components of a graph given as pairs, by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import staged


def components(pairs: DataFrame, max_rounds: int = 50) -> DataFrame:
    """node, root (bigint) for each node in pairs (a, b bigint): root is the least node of its component.

    Each step is a grouped minimum and a join on the node. A hub's neighbours are combined before the shuffle, and as the
    minima are staged, the join with them has nothing above its exchanges that keeps adaptive execution from splitting a
    hub's partition. Steps are staged; the loop ends when a step changes nothing. Null ends and loops are ignored.
    """
    edges = staged(pairs.where("a <> b").select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct(), "edges")
    mark = None
    for _ in range(max_rounds):
        # Large star: of every node, larger neighbours are linked to the least one.
        both = edges.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
        least = staged(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
        # Small star: of every node, smaller neighbours and itself are linked to the least one.
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = large.join(least, "hi").select(F.explode(F.array(F.struct(F.col("hi").alias("hi"), F.col("m").alias("lo")), F.struct(F.col("lo").alias("hi"), F.col("m").alias("lo")))).alias("e")).select("e.*").where("hi <> lo").distinct()
        edges = staged(small, "edges")
        now = tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("hi", "lo"))).first())
        if now == mark:
            break
        mark = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("root")).unionByName(edges.select(F.col("lo").alias("node"), F.col("lo").alias("root"))).distinct()
