"""Does a product meet the context that a code's intermediate heading names?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutyweave.operators.binding import polarity
from dutyweave.staging import stage

# fixed values: the words of a context by what they speak of, words that name no product, and forms that answer for each other
PROCESSING = ("uncooked", "cooked")
PRESERVATION = ("fresh", "chilled", "frozen", "dried", "smoked")
FORMS = ("stuffed", "filled", "minced", "ground", "whole", "piece", "pieces")
FILLED = ("stuffed", "filled")
MINCED = ("minced", "ground", "paste", "puree")
PIECES = ("piece", "pieces", "portion", "portions", "fillet")
LEFT_OVER = ("other", "elsewhere", "specified", "included", "nes")
LEGAL = ("and", "as", "but", "in", "or", "not", "non", "otherwise", "whether", "with", "without", "to", "prepared", "preserved")
SAME_FORM = {"stuffed": FILLED, "filled": FILLED, "minced": MINCED, "ground": MINCED, "whole": ("whole",), "piece": PIECES, "pieces": PIECES}
AGAINST_MINCED = ("whole", "piece", "pieces", "portion", "fillet")
AGAINST_WHOLE = ("minced", "ground", "paste", "puree")
OTHER_FORM = {"minced": AGAINST_MINCED, "ground": AGAINST_MINCED, "whole": AGAINST_WHOLE, "piece": AGAINST_WHOLE, "pieces": AGAINST_WHOLE}
OTHERWISE = r"\botherwise[ -]+prepared\b"
NOT_OTHERWISE = r"\b(?:not|non|without)\b[^,;]{0,48}\botherwise[ -]+prepared\b"
PREPARED = r"\b(?:pre[ -]?cooked|precooked|prepared[ -]+pasta)\b"
UNPREPARED = r"\b(?:unprepared|plain[ -]+uncooked)\b"

AXES = {"form": "physical_form", "processing": "processing_method", "preservation": "preservation_state", "identity": "product_identity"}
CLAUSES = "array<struct<axis:string,expected:string,words:array<string>>>"


def _list(words: tuple[str, ...]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def context_clauses(labels: DataFrame) -> DataFrame:
    """(code, clauses) of labels (code, label), as clauses_of_labels has them; labels of many codes are read once."""
    said = labels.select("code", F.coalesce("label", F.lit("")).alias("label"))
    return said.join(clauses_of_labels(said), "label").select("code", "clauses")


def clauses_of_labels(labels: DataFrame) -> DataFrame:
    """(label, clauses) of each distinct label: what a context asks, as structs (axis, expected, words).

    One clause for each processing state, one for all preservation states, one for each form (one_of for several that "or" joins,
    none under "whether or not"), one for "otherwise prepared", one for the words left over, which name the product. A label of
    legal words alone asks nothing (no_gate); one without words is empty; one whose words all lapse is open.
    """
    low = F.lower(F.trim("label"))
    words = F.array_distinct(F.regexp_extract_all(F.regexp_replace(low, "-", " "), F.lit("[a-z]+"), F.lit(0)))
    held = lambda ws: F.array_sort(F.array_intersect("words", _list(ws)))
    clause = lambda axis, expected, ws: F.struct(F.lit(axis).alias("axis"), F.lit(expected).alias("expected"), ws.alias("words"))
    none = F.array().cast(CLAUSES)
    one = lambda c: F.array(c).cast(CLAUSES)
    each = lambda axis, expected, ws: F.transform(ws, lambda w: clause(axis, expected, F.array(w))).cast(CLAUSES)

    denied = F.array_compact(F.array(*[F.when(F.col("low").rlike(rf"\b(?:not|non|without)[ -]+{f}\b"), f) for f in FORMS]))
    forms = F.when(F.contains(F.col("low"), F.lit("whether or not")), F.array().cast("array<string>")).otherwise(held(FORMS))
    l = labels.select("label").distinct().select("label", low.alias("low"), words.alias("words")).withColumn("forms", forms)
    l = l.withColumn("plain", F.array_except("forms", denied)).withColumn("denied", F.array_except("forms", "plain"))
    l = l.withColumn("named", F.array_sort(F.array_except("words", _list(PROCESSING + PRESERVATION + FORMS + LEGAL + LEFT_OVER))))
    several = (F.size("plain") > 1) & F.contains(F.col("low"), F.lit(" or "))
    otherwise = F.col("low").rlike(r"\botherwise\s+prepared\b")
    denies = F.col("low").rlike(r"\bnot\b[^,;]{0,48}\botherwise\s+prepared\b")
    found = F.concat(
        each("processing_method", "yes", held(PROCESSING)),
        F.when(F.size(held(PRESERVATION)) > 0, one(clause("preservation_state", "yes", held(PRESERVATION)))).otherwise(none),
        F.when(several, one(clause("physical_form", "one_of", F.col("plain")))).otherwise(each("physical_form", "yes", F.col("plain"))),
        each("physical_form", "not", F.col("denied")),
        F.when(otherwise, one(F.struct(F.lit("otherwise_prepared").alias("axis"), F.when(denies, "not").otherwise("yes").alias("expected"), _list(("otherwise prepared",)).alias("words")))).otherwise(none),
        F.when(F.size("named") > 0, one(clause("product_identity", "yes", F.col("named")))).otherwise(none),
    )
    alone = lambda kind: one(clause("branch_context", kind, F.array().cast("array<string>")))
    asks = F.size(F.array_except("words", _list(LEGAL + LEFT_OVER))) > 0
    l = l.withColumn("found", found)
    clauses = F.when(F.size("words") == 0, alone("empty")).when(~asks, alone("no_gate")).when(F.size("found") == 0, alone("open")).otherwise(F.col("found"))
    return stage(l.select("label", clauses.alias("clauses")), "clauses")


def product_signs(bound: DataFrame, texts: DataFrame, wrappers: DataFrame) -> DataFrame:
    """One row a product: status and words of each axis, how its texts speak of a filling and of preparation, its wrapper flag.

    bound (product, axis, status, tokens) is what bind_axis found, tokens joined by blanks (several rows of an axis add up); texts (product, axis, value) are the
    values of the form fields (physical_form) and of the preparation fields (otherwise_prepared); wrappers (product, wrapper).
    """
    words = F.filter(F.split(F.coalesce("tokens", F.lit("")), " "), lambda w: w != "")
    own = lambda a: F.struct(
        F.coalesce(F.bool_or((F.col("axis") == a) & (F.col("status") == "answered")), F.lit(False)).alias("answered"), F.array_distinct(F.flatten(F.collect_list(F.when(F.col("axis") == a, words)))).alias("words")
    )
    kind = F.when(F.col("axis") == "physical_form", polarity(F.col("value"), list(FILLED)))
    low = F.when(F.col("axis") == "otherwise_prepared", F.regexp_replace(F.lower(F.trim("value")), "_", " "))
    # all that is known of a product meets in one shuffle
    every = bound.select("product", "axis", "status", "tokens").unionByName(texts.select("product", kind.alias("kind"), low.alias("low")), allowMissingColumns=True)
    every = every.unionByName(wrappers.select("product", "wrapper"), allowMissingColumns=True)
    return every.groupBy("product").agg(
        *[own(a).alias(c) for c, a in AXES.items()],
        F.bool_or(F.col("kind").isin("positive", "conflict")).alias("filled"), F.bool_or(F.col("kind").isin("negated", "conflict")).alias("unfilled"), F.bool_or(F.col("kind") == "neutral").alias("neutral"),
        F.bool_or(F.col("low").rlike(OTHERWISE) & ~F.col("low").rlike(NOT_OTHERWISE) | F.col("low").rlike(PREPARED)).alias("prepared"),
        F.bool_or(F.col("low").rlike(NOT_OTHERWISE) | F.col("low").rlike(UNPREPARED)).alias("unprepared"),
        F.max("wrapper").alias("wrapper"),
    )


def _said(verdict: str | Column, reason: str) -> Column:
    return F.struct((F.lit(verdict) if isinstance(verdict, str) else verdict).alias("verdict"), F.lit(reason).alias("reason"))


def _silent(reason: str) -> Column:
    return _said("SILENCE", reason)


def _form(form: Column) -> Column:
    """Verdict on one form: the bound words first, then how texts speak of a filling, which a contrary wrapper flag silences."""
    said = F.col("form.words")
    overlap = lambda table: F.coalesce(*[F.when(form == f, F.coalesce(F.arrays_overlap(said, _list(ws)), F.lit(False))) for f, ws in table.items()], F.lit(False))
    same, other = overlap(SAME_FORM), overlap(OTHER_FORM)
    yes, no, wrapper = F.coalesce("filled", F.lit(False)), F.coalesce("unfilled", F.lit(False)), F.col("wrapper")
    signed = (
        F.when(yes & no, _silent("polarity_conflict"))
        .when(yes, F.when(~wrapper, _silent("polarity_conflict:wrapper_false")).otherwise(_said("O", "affirmative_source_text")))
        .when(no, F.when(wrapper, _silent("polarity_conflict:wrapper_true")).otherwise(_said("X", "explicit_negation")))
        .when(F.col("neutral"), _silent("neutral_scope_qualifier")).when(wrapper.isNotNull(), _silent("wrapper_requires_text_corroboration"))
        .otherwise(_silent("physical_form_unanswered"))
    )
    return (
        F.when(same & other, _silent("physical_form_conflict")).when(same, _said("O", "canonical_form_match")).when(other, _said("X", "canonical_form_opposite"))
        .when(form.isin(*FILLED), signed).otherwise(_silent("physical_form_unanswered"))
    )


def _processing(state: Column) -> Column:
    said = F.coalesce("processing.words", F.array().cast("array<string>"))
    has = lambda w: F.array_contains(said, w)
    raw = has("uncooked") | has("requires_cooking") | has("require") & has("cooking")
    same, other = F.when(state == "uncooked", raw).otherwise(has("cooked")), F.when(state == "uncooked", has("cooked")).otherwise(raw)
    return (
        F.when(same & other, _silent("processing_state_conflict")).when(same, _said("O", "processing_state_equivalent")).when(other, _said("X", "processing_state_opposite"))
        .when(F.size(said) > 0, _silent("processing_state_unresolved")).otherwise(_silent("processing_state_unanswered"))
    )


def _turned(said: Column, expected: Column) -> Column:
    verdict = F.when((expected == "not") & (said["verdict"] == "O"), "X").when((expected == "not") & (said["verdict"] == "X"), "O").otherwise(said["verdict"])
    return F.struct(verdict.alias("verdict"), said["reason"].alias("reason"))


def _clause(c: Column) -> Column:
    word = F.get(c["words"], 0)
    any_of = F.transform(c["words"], lambda w: _form(w)["verdict"])
    one_of = F.when(F.array_contains(any_of, "O"), _said("O", "canonical_form_or_match")).when(F.forall(any_of, lambda v: v == "X"), _said("X", "canonical_form_or_mismatch")).otherwise(_silent("canonical_form_or_unanswered"))
    keeps, names = F.coalesce("preservation.answered", F.lit(False)), F.coalesce("identity.answered", F.lit(False))
    preservation = F.when(~keeps, _silent("preservation_state_empty")).when(F.arrays_overlap(c["words"], "preservation.words"), _said("O", "preservation_state_match")).otherwise(_said("X", "preservation_state_mismatch"))
    yes, no = F.coalesce("prepared", F.lit(False)), F.coalesce("unprepared", F.lit(False))
    otherwise = (
        F.when(yes & no, _silent("otherwise_prepared_conflict")).when(yes, _said("O", "explicit_otherwise_prepared")).when(no, _said("X", "explicit_not_otherwise_prepared"))
        .otherwise(_silent("otherwise_prepared_unanswered"))
    )
    identity = (
        F.when(names & (F.size(F.array_except(c["words"], "identity.words")) == 0), _said("O", "canonical_identity_match"))
        .when(F.col("taxon").isin("O", "X"), _said(F.col("taxon"), "taxonomy")).when(~names, _silent("canonical_field_empty")).otherwise(_silent("identity_not_proven"))
    )
    said = (
        F.when(c["axis"] == "processing_method", _processing(word)).when(c["axis"] == "preservation_state", preservation)
        .when(c["axis"] == "physical_form", F.when(c["expected"] == "one_of", one_of).otherwise(_turned(_form(word), c["expected"])))
        .when(c["axis"] == "otherwise_prepared", _turned(otherwise, c["expected"])).when(c["axis"] == "product_identity", identity)
        .when(c["expected"] == "no_gate", _said("O", "residual_context_no_gate")).when(c["expected"] == "empty", _silent("empty_context")).otherwise(_silent("context_clause_coverage_incomplete"))
    )
    return F.struct(c["axis"].alias("axis"), c["expected"].alias("expected"), F.array_join(c["words"], " ").alias("value"), said["verdict"].alias("verdict"), said["reason"].alias("reason"))


def context_verdicts(asks: DataFrame, labels: DataFrame, signs: DataFrame, taxa: DataFrame) -> DataFrame:
    """(product, code, verdict, reason, conditions) of asks (product, code) under labels (code, label) and product_signs.

    X if any clause is X; O only if all are O and each was answered by itself, so never by one_of; else SILENCE. taxa (product,
    code, verdict) says how the product's species answers the code's identity, where its own words do not; codes without a label
    are empty. Clauses stay an array of the row, so asks meet labels and products once each and nothing is expanded; each distinct
    label is read once, and asks carry its number until they have met their products.
    """
    known = labels.groupBy("code").agg(F.min("label").alias("label")).select("code", F.coalesce("label", F.lit("")).alias("label"))
    clauses = stage(clauses_of_labels(known).withColumn("asked", F.monotonically_increasing_id()), "numbered-clauses")
    numbers = known.join(clauses.select("label", "asked"), "label").select("code", "asked")
    # pairs stay narrow until they have met the products; flags, unlike texts, are added up without sorting
    is_said = lambda v: F.coalesce(F.col("verdict") == v, F.lit(False))
    said = taxa.where("product IS NOT NULL AND code IS NOT NULL").select("product", "code", is_said("O").alias("o"), is_said("X").alias("x"), F.coalesce(~F.col("verdict").isin("O", "X"), F.lit(False)).alias("other"), F.lit(False).alias("asks"))
    no = F.lit(False)
    pairs = asks.select("product", "code", no.alias("o"), no.alias("x"), no.alias("other"), F.lit(True).alias("asks")).unionByName(said)
    pairs = pairs.groupBy("product", "code").agg(*[F.bool_or(c).alias(c) for c in ("o", "x", "other", "asks")]).where("asks")
    taxon = F.when(F.col("o") & ~F.col("x") & ~F.col("other"), "O").when(F.col("x") & ~F.col("o") & ~F.col("other"), "X")
    empty = F.array(F.struct(F.lit("branch_context").alias("axis"), F.lit("empty").alias("expected"), F.array().cast("array<string>").alias("words"))).cast(CLAUSES)
    j = pairs.select("product", "code", taxon.alias("taxon")).join(numbers, "code", "left").join(signs, "product", "left").join(clauses.select("asked", "clauses"), "asked", "left")
    j = j.withColumn("clauses", F.coalesce("clauses", empty))
    j = j.select("product", "code", F.transform("clauses", _clause).alias("conditions"))
    v = F.transform("conditions", lambda c: c["verdict"])
    first = F.get("conditions", 0)
    own = first["axis"] == "branch_context"
    merged = F.exists("conditions", lambda c: c["expected"] == "one_of")
    violated, kept = F.array_contains(v, "X"), F.forall(v, lambda x: x == "O")
    reason = (
        F.when(own, first["reason"]).when(violated, "context_condition_violated").when(merged, "context_clause_coverage_incomplete")
        .when(kept, "all_context_conditions_confirmed").otherwise("context_condition_unanswered")
    )
    verdict = F.when(own, first["verdict"]).when(violated, "X").when(kept & ~merged, "O").otherwise("SILENCE")
    return j.select("product", "code", verdict.alias("verdict"), reason.alias("reason"), "conditions")
