"""Distributed connected components by alternating large and small stars.

Each round is two shuffles of the edges that are left; the number of rounds grows
with the logarithm of the longest path. No vertex and no component is gathered in
one place: a large star keeps one row per neighbour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from brackwater.llm.scratch import Scratch


def connected(edges: DataFrame, scratch: Scratch) -> DataFrame:
    """(node, component) for each end of an edge (a, b) of longs; the component is its smallest node.

    Null ends, loops and repeated edges are left out; no edges give an empty table.
    """
    now = scratch.save(
        edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges"
    )
    by_u = Window.partitionBy("u")
    while True:
        # large star: every larger neighbour of u is tied to the least of u and its neighbours
        both = now.union(now.select("v", "u"))
        large = (
            both.withColumn("m", F.least(F.min("v").over(by_u), F.col("u")))
            .where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        )
        # small star: u and its smaller neighbours are tied to the least of them
        least = large.withColumn("m", F.min("v").over(by_u))
        small = (
            least.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
            .select("e.*").where("u <> v").distinct()
        )
        after = scratch.save(small, "edges")
        # done when each node hangs on one root and no root hangs on another
        open_ends = after.groupBy("u").count().where("count > 1").limit(1).count()
        if not open_ends:
            open_ends = after.select("u").join(after.select(F.col("v").alias("u")), "u", "left_semi").limit(1).count()
        scratch.drop(now)
        now = after
        if not open_ends:
            break
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    )
