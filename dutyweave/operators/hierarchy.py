"""Code trees and concept graphs."""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.staging import stage


def build_tree(rows: DataFrame, include_expired: bool = False) -> DataFrame:
    """Adds parent_pos to pre-order rows (chapter, pos, depth): the nearest earlier row of smaller depth. Rows with an end_date take no part.

    For each depth that occurs (a handful) a running maximum of positions; the parent is the largest of those of smaller depths.
    """
    if "end_date" in rows.columns and not include_expired:
        rows = rows.where("end_date IS NULL")
    depths = sorted(r["depth"] for r in rows.select("depth").distinct().collect() if r["depth"] is not None)
    w = Window.partitionBy("chapter").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    last = [F.max(F.when(F.col("depth") == d, F.col("pos"))).over(w) for d in depths]
    nearest = F.greatest(*[F.when(F.col("depth") > d, p) for d, p in zip(depths, last, strict=True)], F.lit(None).cast("long"), F.lit(None).cast("long"))
    return rows.withColumn("parent_pos", nearest)


def tree_summary(nodes: DataFrame) -> DataFrame:
    return nodes.agg(
        F.count(F.lit(1)).alias("nodes"),
        F.count_if(F.col("parent_pos").isNull()).alias("roots"),
        F.max("depth").alias("max_depth"),
        F.countDistinct("chapter").alias("chapters"),
        F.count_if(F.col("leaf")).alias("leaves"),
    )


def children(parents: DataFrame, codes: DataFrame, width: int) -> DataFrame:
    """Prefixes of `width` digits below each parent, each with its smallest code and that code's label."""
    size = F.length("parent")
    k = parents.select("parent", size.alias("_n")).distinct()
    lengths = [r["_n"] for r in k.select("_n").distinct().collect()]  # code lengths: at most ten
    found = None
    for n in lengths:
        part = k.where(F.col("_n") == n).join(codes.withColumn("parent", F.left("code10", F.lit(n))), "parent")
        part = part.select("parent", F.left("code10", F.lit(width)).alias("child"), "code10", "label")
        found = part if found is None else found.unionByName(part)
    return found.groupBy("parent", "child").agg(F.min("code10").alias("code10"), F.min_by("label", F.struct("code10", "label")).alias("label"))


def closure(edges: DataFrame) -> DataFrame:
    """(concept, ancestor, distance) of edges (concept, parent), each concept its own ancestor at 0; smallest distance. Rounds go on until none is new.

    Each round writes only its new rows; what is known is the union of the rounds.
    """
    base = edges.select("concept").union(edges.select("parent")).distinct()
    known = front = stage(base.select("concept", F.col("concept").alias("ancestor"), F.lit(0).alias("distance")), "closure")
    for d in count(1):
        step = front.join(edges.select(F.col("concept").alias("ancestor"), "parent"), "ancestor").select("concept", F.col("parent").alias("ancestor")).distinct()
        front = stage(step.join(known, ["concept", "ancestor"], "left_anti").withColumn("distance", F.lit(d)), "closure")
        if front.isEmpty():
            return known
        known = known.unionByName(front)


def most_specific(found: DataFrame, closed: DataFrame) -> DataFrame:
    """Drops a concept of a subject when a concept below it was found too."""
    below = found.join(closed.where("distance > 0"), "concept").select("subject", F.col("ancestor").alias("concept")).distinct()
    return found.join(below, ["subject", "concept"], "left_anti")


def level_labels(nodes: DataFrame, from_depth: int) -> DataFrame:
    """Labels assembled from headers deeper than from_depth and the node's own text."""
    parts = F.filter("path", lambda x: x["depth"] > from_depth)
    return nodes.select("node", F.array_join(F.transform(F.array_sort(parts), lambda x: x["label"]), " ; ").alias("label"))
