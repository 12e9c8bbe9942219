"""Does the evidence that a fact refers to bear it out?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutyweave.functions.text import quantities

#: Words that a fact needs so that half of them in the evidence are enough.
HALF_FROM = 4


def _compact(text: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))


def _sizes(text: Column) -> Column:
    return F.array_distinct(F.transform(quantities(text), lambda q: F.concat(q["value"], q["unit"])))


def validate_facts(facts: DataFrame, evidence: DataFrame) -> DataFrame:
    """(fact_id, verdict) of facts (fact_id, product, kind, text, refs) under evidence (ref, product, source, in_section, text).

    The first that holds: no_reference; unknown_reference, one that the product's evidence lacks; quantity_missing, one of the fact's
    that no evidence has; for ingredients no_label_evidence, and outside_section where no label evidence lies in the ingredient
    section; not_supported, where the text is in no evidence, not all of its words are, and not half of them, if it has HALF_FROM or
    more. Else valid. Facts, one row each, meet their evidence once, by reference; words and quantities are compared within the pair.
    """
    refs = F.array_distinct(F.filter(F.coalesce("refs", F.array().cast("array<string>")), lambda r: r.isNotNull()))
    f = facts.select("fact_id", "product", "kind", _compact(F.col("text")).alias("own"), _words(F.col("text")).alias("words"), _sizes(F.col("text")).alias("sizes"), refs.alias("refs"))
    e = evidence.select("product", "ref", "source", "in_section", *[of(F.col("text")).alias(c) for c, of in (("said", _compact), ("said_words", _words), ("said_sizes", _sizes))], F.lit(True).alias("known"))
    met = f.withColumn("n_refs", F.size("refs")).withColumn("ref", F.explode_outer("refs")).drop("refs").join(e, ["product", "ref"], "left")
    # of words and quantities only those of the fact itself are collected, so that a group is no larger than the fact
    met = met.select(
        "fact_id", "product", "kind", "n_refs", F.size("words").alias("n_words"), F.size("sizes").alias("n_sizes"), "source", "in_section", "known", ((F.col("own") != "") & F.contains("said", "own")).alias("whole"),
        F.array_intersect("words", "said_words").alias("words"), F.array_intersect("sizes", "said_sizes").alias("sizes"),
    )
    label = F.coalesce(F.col("source") == "label", F.lit(False))
    distinct = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c))))
    j = met.groupBy("fact_id", "product", "kind", "n_refs", "n_words", "n_sizes").agg(
        F.bool_or(F.col("known").isNull()).alias("unknown"), F.bool_or(label).alias("label"), F.bool_or(label & F.coalesce("in_section", F.lit(False))).alias("section"), F.bool_or("whole").alias("whole"),
        distinct("words").alias("there"), distinct("sizes").alias("sized"),
    )
    enough = F.col("whole") | (F.col("n_words") > 0) & ((F.col("there") == F.col("n_words")) | (F.col("n_words") >= HALF_FROM) & (F.col("there") * 2 >= F.col("n_words")))
    ingredient = F.col("kind") == "ingredient"
    verdict = (
        F.when(F.col("n_refs") == 0, "no_reference").when(F.col("unknown"), "unknown_reference").when(F.col("sized") < F.col("n_sizes"), "quantity_missing").when(ingredient & ~F.col("label"), "no_label_evidence")
        .when(ingredient & ~F.col("section"), "outside_section").when(~F.coalesce(enough, F.lit(False)), "not_supported").otherwise("valid")
    )
    return j.select("fact_id", verdict.alias("verdict"))
