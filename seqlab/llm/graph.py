"""Connected components of a link table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


#: Rounds at most; they grow with the logarithm of a component's size, so this many are never needed.
ROUNDS = 64


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, root): the smallest node of each linked node's component. Links in any direction, repeats and loops are fine.

    Each round is a minimum by node (combined before the shuffle) and a join that Spark may split on hot
    nodes, as both sides are tables in the shared folder, where the links between rounds lie too. Ends when all links lead to roots.
    """
    edges = links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct()
    edges = stored(edges, "links")
    for _ in range(ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = stored(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = both.filter("v > u").join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large, "large")
        least = stored(large.groupBy("u").agg(F.min("v").alias("m")), "least")
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        edges = stored(small.filter("u <> v").distinct(), "links")
        if edges.select("v").distinct().join(edges.select(F.col("u").alias("v")).distinct(), "v", "left_semi").isEmpty():
            repeated = edges.groupBy("u").agg(F.count("*").alias("n")).filter("n > 1")
            if repeated.isEmpty():
                return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    raise RuntimeError(f"components are not done after {ROUNDS} rounds")
