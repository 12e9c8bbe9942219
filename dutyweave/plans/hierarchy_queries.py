"""Registered queries on code trees, with their SQL twins."""

from __future__ import annotations

from dutyweave.operators import hierarchy as ops
from dutyweave.plans import views
from pyspark.sql import functions as F
from pyspark.sql.window import Window

D_NODES = """nodes AS (SELECT DISTINCT substr(code10, 1, n) AS prefix, n // 2 - 1 AS depth, substr(code10, 1, 2) AS chapter FROM goods, (VALUES (2), (4), (6), (8), (10)) AS t(n)),
pos AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY rpad(prefix, 10, '0'), depth) AS pos FROM nodes),
tree AS (SELECT c.*, p.pos AS parent_pos FROM pos c LEFT JOIN pos p ON p.prefix = substr(c.prefix, 1, length(c.prefix) - 2) AND c.depth > 0)"""
D_EDGES = "edges AS (SELECT prefix AS concept, substr(prefix, 1, length(prefix) - 2) AS parent FROM nodes WHERE depth > 0)"
D_CLOSED = "closed AS (SELECT concept, ancestor, distance FROM (SELECT prefix AS concept, substr(prefix, 1, length(prefix) - 2 * k) AS ancestor, k AS distance, depth FROM nodes, range(5) AS r(k)) WHERE distance <= depth)"


def nodes(s, d):
    g = views.goods(s, d)
    n = g.select("code10", F.explode(F.array(*[F.lit(x) for x in (2, 4, 6, 8, 10)])).alias("n"))
    n = n.select(F.left("code10", F.col("n")).alias("prefix"), (F.col("n") / 2 - 1).cast("int").alias("depth"), F.left("code10", F.lit(2)).alias("chapter")).distinct()
    return n.withColumn("pos", F.row_number().over(Window.partitionBy("chapter").orderBy(F.rpad("prefix", 10, "0"), "depth")).cast("long"))


def edges(s, d):
    return nodes(s, d).where("depth > 0").select(F.col("prefix").alias("concept"), F.left("prefix", F.length("prefix") - 2).alias("parent"))


def _found(s, d):
    g = views.goods(s, d)
    l = views.table(s, d, "lineitem")
    j = l.join(g, l["l_partkey"] == g["p_partkey"])
    return j.select(F.col("l_suppkey").alias("subject"), F.left("code10", (2 + 2 * (F.col("l_linenumber") % 5)).cast("int")).alias("concept")).distinct()


def _paths(s, d):
    path = F.array(*[F.struct(F.lit(i).alias("depth"), F.concat(F.lit("h"), F.left("code10", F.lit(2 * i + 2))).alias("label")) for i in range(5)])
    return views.goods(s, d).select(F.col("code10").alias("node"), path.alias("path")).distinct()


QUERIES = {
    "build_tree": (
        lambda s, d: ops.build_tree(nodes(s, d).withColumn("end_date", F.when((F.col("pos") % 7 == 3) & (F.col("depth") > 0), "2020-12-31"))).drop("end_date"),
        f"""{views.WITH_GOODS}, {D_NODES}, live AS (SELECT * FROM pos WHERE NOT (pos % 7 = 3 AND depth > 0))
        SELECT *, (SELECT max(p.pos) FROM live p WHERE p.chapter = c.chapter AND p.pos < c.pos AND p.depth < c.depth) AS parent_pos FROM live c""",
    ),
    "tree_summary": (
        lambda s, d: ops.tree_summary(ops.build_tree(nodes(s, d)).withColumn("leaf", F.col("depth") == 4)),
        f"{views.WITH_GOODS}, {D_NODES} SELECT count(*) AS nodes, count_if(parent_pos IS NULL) AS roots, max(depth) AS max_depth, count(DISTINCT chapter) AS chapters, count_if(depth = 4) AS leaves FROM tree",
    ),
    "children": (
        lambda s, d: ops.children(views.goods(s, d).select(F.left("code10", F.lit(2)).alias("parent")).union(views.goods(s, d).select(F.left("code10", F.lit(4)))).distinct(), views.goods(s, d), 6),
        f"""{views.WITH_GOODS}, p AS (SELECT DISTINCT substr(code10, 1, n) AS parent FROM goods, (VALUES (2), (4)) AS t(n))
        SELECT parent, substr(code10, 1, 6) AS child, min(code10) AS code10, first(label ORDER BY code10, label) AS label FROM p JOIN goods ON starts_with(code10, parent) GROUP BY ALL""",
    ),
    "closure": (lambda s, d: ops.closure(edges(s, d)), f"{views.WITH_GOODS}, {D_NODES}, {D_CLOSED} SELECT * FROM closed"),
    "most_specific": (
        lambda s, d: ops.most_specific(_found(s, d), ops.closure(edges(s, d))),
        f"""{views.WITH_GOODS}, f AS (SELECT DISTINCT l_suppkey AS subject, substr(code10, 1, 2 + 2 * (l_linenumber % 5)) AS concept FROM lineitem JOIN goods ON l_partkey = p_partkey)
        SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM f g WHERE g.subject = f.subject AND length(g.concept) > length(f.concept) AND starts_with(g.concept, f.concept))""",
    ),
    "level_labels": (
        lambda s, d: ops.level_labels(_paths(s, d), 1),
        f"{views.WITH_GOODS} SELECT DISTINCT code10 AS node, 'h' || substr(code10, 1, 6) || ' ; h' || substr(code10, 1, 8) || ' ; h' || code10 AS label FROM goods",
    ),
}
