"""Connected components of an edge table, by alternating large and small stars.

Edges, labels and counts stay in Spark; only two sums per round reach the driver. Each round is
a minimum per node and a join with it, so a node with very many edges is one partial aggregate
per task and a join side that Spark may split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._store import drop, materialize


def components(edges: DataFrame) -> DataFrame:
    """`edges` (a, b) to (node, component): the smallest node reachable, for each node with an edge."""
    now = materialize(edges.select("a", "b").where("a != b").distinct(), "links")
    state = None
    while True:
        both = now.unionAll(now.select("b", "a")).toDF("u", "v")
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        down = large.where("a != b").distinct()  # a > b
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.*")
        new = materialize(small.where("a != b").distinct(), "stars")
        # order-free and exact in its sums: equal only if the edge set is the same
        total = new.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        drop(now)
        now = new
        if tuple(total) == state:
            break
        state = tuple(total)
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionAll(now.select("b", "b").distinct())
