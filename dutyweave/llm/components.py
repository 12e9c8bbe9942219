"""Connected components of an edge table by alternating large and small stars.

Each round replaces edges by edges to smaller neighbours, until every component is a
star around its smallest node. A round is two aggregations and two joins on the edge
table; nothing is gathered on the driver, and a node's neighbours never meet in one
task: their minimum is combined on the map side and joined back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dutyweave.staging import discard, stage


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    least = down.groupBy("a").agg(F.min("b").alias("m"))
    moved = down.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    return moved.unionByName(least.select("a", F.col("m").alias("b"))).distinct()


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of edges (a, b); component: the smallest node reachable. Rounds go on until nothing changes."""
    edges = stage(edges.select("a", "b").where("a <> b").distinct(), "edges")
    last = None
    while True:
        before, edges = edges, stage(_small_star(_large_star(edges)), "stars")
        discard(before)
        seen = edges.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x"), F.sum(F.col("b").cast("decimal(38,0)")).alias("s")).first()
        if seen == last:
            break
        last = seen
    nodes = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return nodes.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())
