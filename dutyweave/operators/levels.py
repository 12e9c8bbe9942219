"""Products down a code tree, one level after the other, with one winner a product and level.

Inputs: starts (product, parent), the two-digit scopes a product may be in; nodes (code,
parent, residual); conditions (code, row_id, alt_group, field, value); facts (product,
field, value), what is known of each product; precedents (product, code).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.operators import classify
from dutyweave.operators.classes import representatives, to_members
from dutyweave.staging import stage

LEVELS = (4, 6, 8)


def alike(survivors: DataFrame, nodes: DataFrame, conditions: DataFrame, facts: DataFrame, precedents: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(survivors, facts, precedents) of one product of each class, and (product, of) of every product.

    Products of a class have the same parents and know the same of what the codes below these ask: which of the values named there,
    and of a field with other values only that it is answered. The same of these codes have precedents, where they count.
    """
    asked = stage(nodes.join(conditions, "code").select("parent", "field", "value").distinct(), "level-asked")
    near = survivors.join(facts.select("product", "field", "value"), "product").join(asked.select("parent", "field").distinct(), ["parent", "field"])
    near = near.join(asked.withColumn("_asked", F.lit(True)), ["parent", "field", "value"], "left").select("product", "field", F.when(F.col("_asked"), F.col("value")).alias("value"))
    rows = survivors.select("product", F.lit("parent").alias("kind"), "parent").unionByName(near.withColumn("kind", F.lit("fact")), allowMissingColumns=True)
    if precedents is not None:
        known = survivors.join(precedents.select("product", "code"), "product").join(nodes.select("parent", "code").distinct(), ["parent", "code"]).select("product", "code")
        rows = rows.unionByName(known.withColumn("kind", F.lit("precedent")), allowMissingColumns=True)
    else:
        rows = rows.withColumn("code", F.lit(None).cast("string"))
    first, members = representatives(rows, "product")
    first = stage(first, "level-classes")
    kind = lambda k, *columns: first.where(F.col("kind") == k).select("product", *columns)
    return kind("parent", "parent"), kind("fact", "field", "value"), kind("precedent", "code"), members


def detail_verdicts(candidates: DataFrame, conditions: DataFrame, facts: DataFrame) -> DataFrame:
    """Rows (product, parent, code, residual, row_id, alt_group, field, value, verdict): null where nothing is known of the field, else whether the value is."""
    known = facts.select("product", "field", "value").distinct()
    answered = known.groupBy("product", "field").agg(F.lit(True).alias("_answered"))
    d = candidates.join(conditions, "code").join(answered, ["product", "field"], "left").join(known.withColumn("_held", F.lit(True)), ["product", "field", "value"], "left")
    verdict = F.when(F.col("_answered"), F.coalesce("_held", F.lit(False)))
    return d.select("product", "parent", "code", "residual", "row_id", "alt_group", "field", "value", verdict.alias("verdict"))


def explicit_matches(details: DataFrame, nodes: DataFrame, conditions: DataFrame) -> DataFrame:
    """(product, code) of named codes with a met value that no residual code of the same parent has among its own."""
    covered = nodes.where("residual").join(conditions, "code").select("parent", "value").distinct()
    return details.where("verdict AND NOT residual").join(covered, ["parent", "value"], "left_anti").select("product", "code").distinct()


def rank_candidates(candidates: DataFrame, details: DataFrame, explicit: DataFrame) -> DataFrame:
    """Decision and score of each candidate: 3 for each met condition, 50 if confirmed, -100 if violated; asked: whether it has any condition.

    A confirmed named code needs an explicit match; without one it is undecided.
    """
    rolled = classify.roll_up(details, ["product", "code"])
    met = details.groupBy("product", "code").agg(F.count_if(F.col("verdict")).alias("met"))
    r = candidates.join(rolled, ["product", "code"], "left").join(met, ["product", "code"], "left").join(explicit.withColumn("explicit", F.lit(True)), ["product", "code"], "left")
    bare = (F.col("decision") == "confirmed") & ~F.col("residual") & F.col("explicit").isNull()
    r = r.withColumn("asked", F.col("decision").isNotNull()).withColumn("decision", F.when(F.col("decision").isNull() | bare, "undecided").otherwise(F.col("decision")))
    score = 3 * F.coalesce("met", F.lit(0)) + F.when(F.col("decision") == "confirmed", 50).when(F.col("decision") == "violated", -100).otherwise(0)
    return r.select("product", "parent", "code", "residual", "decision", score.cast("long").alias("score"), "asked", (F.coalesce("met", F.lit(0)) > 0).alias("answered"))


def promote_residual(scored: DataFrame, proofs: DataFrame, floor: int = -50) -> DataFrame:
    """Order of codes under one parent, and the phase of those it was decided for.

    scored (product, parent, code, residual, score, asked, answered); proofs (product, code). Residual codes above the floor lead
    where questions were asked and no named code with a positive score is proven: residual_promoted. Else the best named code leads
    if its score is positive: qualified_named where one of its conditions is met, unqualified_question where none is. Else residual
    codes come first, without proof: unqualified_question.
    """
    w = Window.partitionBy("product", "parent")
    named, positive = ~F.col("residual"), F.col("score") > 0
    r = scored.join(proofs.select("product", "code").distinct().withColumn("_proven", F.lit(True)), ["product", "code"], "left")
    proven = (F.col("_proven").isNotNull()) & named & positive
    r = r.withColumn("_viable", F.col("residual") & (F.col("score") > floor) & F.bool_or("asked").over(w))
    r = r.withColumn("_promote", F.bool_or("_viable").over(w) & F.bool_or(named).over(w) & ~F.bool_or(proven).over(w))
    r = r.withColumn("_lead", F.bool_or(named & positive).over(w))
    group = F.when(F.col("_promote"), F.when(F.col("_viable"), 0).when(named, 1).otherwise(2)).when(F.col("_lead"), F.when(named, 0).otherwise(1)).otherwise(F.when(named, 1).otherwise(0))
    r = r.withColumn("place", F.row_number().over(w.orderBy(group, F.desc("score"), "code")))
    leads = F.max(F.when(F.col("place") == 1, F.col("answered"))).over(w)
    phase = (
        F.when(F.col("_promote"), F.when(F.col("_viable") | named, "residual_promoted"))
        .when(F.col("_lead") & leads, F.when(F.col("place") == 1, "qualified_named"))
        .otherwise("unqualified_question")
    )
    return r.select("product", "parent", "code", phase.alias("phase"), "place")


def level_step(survivors: DataFrame, nodes: DataFrame, conditions: DataFrame, facts: DataFrame, precedents: DataFrame, level: int) -> tuple[DataFrame, DataFrame]:
    """Of survivors (product, parent): one row a product (product, level, code, authority, candidates, leader, phase), and the silent details (product, level, field, value) of those without a winner.

    At four digits the codes of all scopes compete; deeper, a product has one parent. A lone candidate passes through.
    """
    candidates = stage(survivors.join(nodes, "parent"), "level-candidates")
    details = stage(detail_verdicts(candidates, conditions, facts), "level-details")
    explicit = explicit_matches(details, nodes, conditions)
    ranked = stage(rank_candidates(candidates, details, explicit), "level-ranked")
    fell = classify.general_rule_cascade(ranked.drop("parent"), precedents, level).where("loses").select("product", "code", F.lit(True).alias("_fell"))
    kept = ranked.join(fell, ["product", "code"], "left").withColumn("decision", F.when(F.col("_fell"), "undecided").otherwise(F.col("decision")))
    chosen = classify.authoritative_selection(kept.withColumn("parent", F.lit("")).select("product", "parent", "code", "residual", "decision")).drop("parent")
    order = promote_residual(ranked, explicit).where("place = 1").join(ranked.select("product", "code", "score"), ["product", "code"])
    lead = order.groupBy("product").agg(F.max_by(F.struct("code", "phase"), F.struct("score", "code")).alias("_lead"))
    alone = candidates.groupBy("product").agg(F.count(F.lit(1)).alias("candidates"), F.min("code").alias("_only"))
    one = survivors.select("product").distinct().join(alone, "product", "left").join(chosen, "product", "left").join(lead, "product", "left")
    passes = F.col("candidates") == 1
    code = F.when(passes, F.col("_only")).otherwise(F.col("selected"))
    authority = F.when(F.col("candidates").isNull(), "no_children").when(passes, "pass_through").otherwise(F.col("why"))
    result = one.select("product", F.lit(level).alias("level"), code.alias("code"), authority.alias("authority"), F.coalesce("candidates", F.lit(0)).alias("candidates"), F.col("_lead.code").alias("leader"), F.col("_lead.phase").alias("phase"))
    result = stage(result, "level-result")
    silent = details.where("verdict IS NULL").join(result.where("code IS NULL"), "product", "left_semi").select("product", F.lit(level).alias("level"), "field", "value").distinct()
    return result, stage(silent, "level-silent")


def _descend(starts: DataFrame, nodes: DataFrame, conditions: DataFrame, facts: DataFrame, precedents: DataFrame, levels: tuple[int, ...]) -> list[tuple[DataFrame, DataFrame, DataFrame]]:
    """(result of every product, silent of one product of each class, members) of each level: a level's work is done once for each class."""
    nodes, conditions = stage(nodes, "level-nodes"), stage(conditions, "level-conditions")
    survivors, found = stage(starts.select("product", "parent").distinct(), "level-starts"), []
    for level in levels:
        *one, members = alike(survivors, nodes, conditions, facts, precedents)
        members = stage(members, "level-members")
        parents, known, before = one
        result, silent = level_step(parents, nodes, conditions, known, before, level)
        result = stage(to_members(result, members, "product"), "level-results")
        found.append((result, silent, members))
        survivors = result.where("code IS NOT NULL").select("product", F.col("code").alias("parent"))
    return found


def _together(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def classify_levels(starts: DataFrame, nodes: DataFrame, conditions: DataFrame, facts: DataFrame, precedents: DataFrame, levels: tuple[int, ...] = LEVELS) -> tuple[DataFrame, DataFrame]:
    """(result, silent) of all levels, as level_step has them; products leave at the first level that gives no winner, with their open questions."""
    found = _descend(starts, nodes, conditions, facts, precedents, levels)
    return _together([result for result, _, _ in found]), _together([to_members(silent, members, "product") for _, silent, members in found])


def level_questions(silent: DataFrame, most: int = 8) -> DataFrame:
    """What to ask of products that left: one question a field and value, most at most a product, with the level where it left."""
    asked = classify.questions(silent.select("product", "field", "value"), most)
    return asked.join(silent.select("product", "level").distinct(), "product")


def questions_of_levels(starts: DataFrame, nodes: DataFrame, conditions: DataFrame, facts: DataFrame, precedents: DataFrame, levels: tuple[int, ...] = LEVELS, most: int = 8) -> DataFrame:
    """level_questions of what classify_levels leaves silent; they are chosen once for each class of products."""
    found = _descend(starts, nodes, conditions, facts, precedents, levels)
    return _together([to_members(stage(level_questions(silent, most), "level-questions"), members, "product") for _, silent, members in found])
