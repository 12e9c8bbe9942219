"""Agreement, recall and observation counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def recall(predictions: DataFrame, labels: DataFrame, k: int = 5) -> DataFrame:
    """Evaluated cases, first and top-k matches at 2, 4, 6, 8 and 10 digits."""
    j = predictions.join(labels.select("case_id", F.col("code10").alias("truth")), "case_id")
    j = j.withColumn("level", F.explode(F.array(*[F.lit(n) for n in (2, 4, 6, 8, 10)])))
    same = F.left("code10", F.col("level")) == F.left("truth", F.col("level"))
    each = j.groupBy("level", "case_id").agg(F.bool_or(same & (F.col("rank") == 1)).alias("top1"), F.bool_or(same & (F.col("rank") <= k)).alias("topk"))
    g = each.groupBy("level").agg(F.count(F.lit(1)).alias("evaluated"), F.count_if("top1").alias("top1"), F.count_if("topk").alias("topk"))
    return g.withColumn("top1_ratio", F.round(F.col("top1") / F.col("evaluated"), 6)).withColumn("topk_ratio", F.round(F.col("topk") / F.col("evaluated"), 6))


def table_agreement(left: DataFrame, right: DataFrame, key: str = "table_id") -> DataFrame:
    """Multiset precision, recall and F1 of cell texts for each table."""
    a = left.groupBy(key, "cell").agg(F.count(F.lit(1)).alias("a"))
    b = right.groupBy(key, "cell").agg(F.count(F.lit(1)).alias("b"))
    j = a.join(b, [key, "cell"], "full").na.fill(0, ["a", "b"])
    g = j.groupBy(key).agg(F.sum(F.least("a", "b")).alias("both"), F.sum("a").alias("na"), F.sum("b").alias("nb"))
    p, r = F.col("both") / F.nullif(F.col("nb"), F.lit(0)), F.col("both") / F.nullif(F.col("na"), F.lit(0))
    return g.select(key, F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(2 * F.col("both") / (F.col("na") + F.col("nb")), 6).alias("f1"))


def fact_agreement(facts: DataFrame) -> DataFrame:
    """Jaccard similarity of the facts of each pair of routes, 0 for pairs that share none. Routes are a handful of engines."""
    f = facts.select("route", "fact").distinct()
    n = f.groupBy("route").agg(F.count(F.lit(1)).alias("n"))
    every = n.agg(F.array_sort(F.collect_list(F.struct("route", "n"))).alias("r")).select("r", F.inline("r"))
    every = every.select("route", "n", F.explode(F.filter("r", lambda o: o["route"] > F.col("route"))).alias("o")).select("route", "n", F.col("o.route").alias("other"), F.col("o.n").alias("m"))
    s = f.join(f.select(F.col("route").alias("other"), "fact"), "fact").where("route < other").groupBy("route", "other").agg(F.count(F.lit(1)).alias("shared"))
    j = every.join(s, ["route", "other"], "left").na.fill(0, ["shared"])
    return j.select("route", "other", "shared", F.round(F.col("shared") / (F.col("n") + F.col("m") - F.col("shared")), 6).alias("jaccard"))


def observe_bindings(observations: DataFrame) -> DataFrame:
    """Counts by (axis, field, verdict, supports), from each subject's latest run."""
    latest = observations.groupBy("subject").agg(F.max("run").alias("run"))
    return observations.join(latest, ["subject", "run"]).groupBy("axis", "field", "verdict", "supports").agg(F.count(F.lit(1)).alias("n"))


def qualified_bindings(matrix: DataFrame, least: int = 10, precision: float = 0.25) -> DataFrame:
    """Bindings seen often enough whose true verdicts support the answer often enough."""
    g = matrix.where("verdict = 'true'").groupBy("axis", "field").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("supports"), F.col("n")).otherwise(0)).alias("good"))
    return g.withColumn("precision", F.round(F.col("good") / F.col("n"), 6)).where((F.col("n") >= least) & (F.col("precision") >= precision))


def compare_quantities(left: DataFrame, right: DataFrame) -> DataFrame:
    """ok, mismatch (less than half of the quantities shared) or conflict (one number, other units) of each subject."""
    a = left.groupBy("subject", "value").agg(F.collect_set("unit").alias("ua"))
    b = right.groupBy("subject", "value").agg(F.collect_set("unit").alias("ub"))
    j = a.join(b, ["subject", "value"], "full")
    both = F.col("ua").isNotNull() & F.col("ub").isNotNull()
    g = j.groupBy("subject").agg(F.count_if(both).alias("shared"), F.count(F.lit(1)).alias("n"), F.count_if(both & ~F.arrays_overlap("ua", "ub")).alias("clash"))
    return g.select("subject", "shared", "n", F.when(F.col("clash") > 0, "conflict").when(F.col("shared") * 2 < F.col("n"), "mismatch").otherwise("ok").alias("verdict"))


def dedupe_boxes(boxes: DataFrame, least: float = 0.65) -> DataFrame:
    """Boxes that stay, page by page in order of box_id: one goes if a box kept before it has the same text (blanks folded, not empty) or covers it by `least`, intersection over union.

    A page's boxes are gathered; a page holds a bounded number of them.
    """
    folded = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    box = F.struct("box_id", *[F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")], folded.alias("text"))
    area = lambda b: F.greatest(b["x2"] - b["x1"], F.lit(0.0)) * F.greatest(b["y2"] - b["y1"], F.lit(0.0))

    def repeats(kept: Column, b: Column) -> Column:
        w = F.greatest(F.least(kept["x2"], b["x2"]) - F.greatest(kept["x1"], b["x1"]), F.lit(0.0))
        h = F.greatest(F.least(kept["y2"], b["y2"]) - F.greatest(kept["y1"], b["y1"]), F.lit(0.0))
        union = area(kept) + area(b) - w * h
        return ((b["text"] != "") & (kept["text"] == b["text"])) | ((union > 0) & (w * h >= least * union))

    pages = boxes.groupBy("page").agg(F.array_sort(F.collect_list(box)).alias("all"))
    kept = F.aggregate("all", F.slice("all", 1, 0), lambda k, b: F.when(F.exists(k, lambda o: repeats(o, b)), k).otherwise(F.concat(k, F.array(b))))
    return boxes.join(pages.select("page", F.explode(F.transform(kept, lambda b: b["box_id"])).alias("box_id")), ["page", "box_id"], "left_semi")
