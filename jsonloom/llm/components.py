"""Connected components of a graph of number pairs, by stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from jsonloom.llm.common import Scratch


def components(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, root) of every node of edges (a, b); root is the smallest node reachable.

    Every round hangs the larger neighbours of a node on the smallest (large star), then
    the smaller ones (small star), until all hang on roots.  Each step is one aggregate
    and one join over the edges and is written, so no component is gathered anywhere.
    """
    now = scratch.store(
        edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges"
    )
    while True:
        both = now.select("u", "v").union(now.select(F.col("v"), F.col("u")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = scratch.store(large.filter("u <> v").distinct(), "large-star")
        scratch.drop(now)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low)
        now = scratch.store(small.filter("u <> v").distinct(), "small-star")
        scratch.drop(large)
        leaves = now.select(F.col("u").alias("x"), F.lit(1).alias("leaf"), F.lit(0).alias("root"))
        roots = now.select("v").distinct().select(F.col("v").alias("x"), F.lit(0).alias("leaf"), F.lit(1).alias("root"))
        roles = leaves.union(roots).groupBy("x").agg(F.sum("leaf").alias("leaf"), F.max("root").alias("root"))
        if roles.filter("leaf > 1 or (leaf > 0 and root > 0)").isEmpty():
            break  # every node hangs on one root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(
        now.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    )
