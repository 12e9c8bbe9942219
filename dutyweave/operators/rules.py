"""Compiling nomenclature wording into rows of conditions, all groups of siblings at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.functions import text


def split_labels(labels: DataFrame, blank_conditional: bool = True) -> DataFrame:
    """Leaf and ancestor parts of labels split at " ; "; conditional clauses are blanked after the split, the residual test looks at the leaf."""
    parts = F.split("label", " ; ")
    blank = (lambda c: F.trim(F.regexp_replace(c, "(?i)" + text.WHETHER_CLAUSE, " "))) if blank_conditional else (lambda c: c)
    leaf, n = F.element_at(parts, -1), F.size(parts)
    above = F.transform(F.slice(parts, F.lit(1), F.greatest(n - 1, F.lit(0))), lambda p: blank(p))
    return labels.select("parent", "code", blank(leaf).alias("leaf"), F.array_join(above, " ; ").alias("above"), text.is_residual(leaf).alias("residual"))


def rare_words(words: DataFrame) -> DataFrame:
    """Words of a group (parent, code, word) that at most half of its codes hold."""
    w = words.select("parent", "code", "word").distinct()
    size = w.groupBy("parent").agg(F.countDistinct("code").alias("n"))
    df = w.groupBy("parent", "word").agg(F.count(F.lit(1)).alias("df"))
    return w.join(df, ["parent", "word"]).join(size, "parent").where("df * 2 <= n").select("parent", "code", "word", "df", "n")


def clean_values(rows: DataFrame) -> DataFrame:
    """Drops a value that max(2, n/2) or more of a group's n codes own; a code that would lose all keeps its longest, then first."""
    v = rows.select("parent", "code", "value").distinct()
    size = v.groupBy("parent").agg(F.countDistinct("code").alias("n"))
    owners = v.groupBy("parent", "value").agg(F.count(F.lit(1)).alias("owners"))
    j = v.join(owners, ["parent", "value"]).join(size, "parent").withColumn("drop", F.col("owners") >= F.greatest(F.lit(2.0), F.col("n") / 2))
    w = Window.partitionBy("parent", "code")
    j = j.withColumn("kept", F.count_if(~F.col("drop")).over(w)).withColumn("r", F.row_number().over(w.orderBy(F.desc(F.length("value")), "value")))
    return j.where("NOT drop OR (kept = 0 AND r = 1)").select("parent", "code", "value", (F.col("kept") == 0).alias("fallback"))


def mirror_exclusions(values: DataFrame, residuals: DataFrame, most: int = 8) -> DataFrame:
    """A residual code excludes the values of its named siblings, most at most."""
    j = residuals.select("parent", F.col("code").alias("residual")).join(values, "parent").where("code <> residual")
    first = j.groupBy("parent", "residual", "value").agg(F.min("code").alias("code"))
    order = Window.partitionBy("parent", "residual").orderBy("code", "value")
    return first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("parent", "residual", "value", "place")


def mine_aliases(lineages: DataFrame, most: int = 6) -> DataFrame:
    """For each word of a child, the classes that all its lineages hold: rows (word, lineage, class)."""
    l = lineages.select("word", "lineage", "cls").distinct()
    n = l.groupBy("word").agg(F.countDistinct("lineage").alias("n"))
    held = l.groupBy("word", "cls").agg(F.countDistinct("lineage").alias("k")).join(n, "word").where("k = n")
    order = Window.partitionBy("word").orderBy("cls")
    return held.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most).select("word", "cls", "n", "place")


def coverage(rows: DataFrame) -> DataFrame:
    """Rows, tagged rows and percent by level and axis, with totals (level or axis null)."""
    g = rows.rollup("level", "axis").agg(F.count(F.lit(1)).alias("n"), F.count_if("tagged").alias("n_tagged"))
    return g.withColumn("percent", F.round(100 * F.col("n_tagged") / F.col("n"), 4))


def chapter_words(chapters: DataFrame, stop: list[str], first: int = 24, most: int = 10) -> DataFrame:
    """Distinct words among the first words of a title, stop words left out."""
    words = F.slice(F.regexp_extract_all(F.lower("title"), F.lit("[a-z]+"), F.lit(0)), 1, first)
    kept = F.slice(F.array_distinct(F.filter(words, lambda w: ~w.isin(*stop))), 1, most)
    return chapters.select("chapter", F.array_join(kept, " ").alias("words"))
