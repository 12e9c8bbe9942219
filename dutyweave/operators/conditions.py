"""Conditions of a code from its label: typed by a table of patterns, its qualifiers, and its identity where no pattern finds one."""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutyweave.functions.text import is_residual, stem
from dutyweave.operators.alternatives import alternation_atoms, group_values
from dutyweave.operators.phrases import DENIAL, OPTIONAL_CLAUSE, QUANTITY_HEADS, QUANTITY_WORDS, phrase_units

# fixed values: characters after an operator word that may hold its object, and how a note excludes
WINDOW = 80
EXCLUDES = r"(?i)(?:does not cover|do not cover|excludes?|excluding|are not included|is not included|not covered by)[:\s]+([^.;(]{4,90})"

ROW = "array<struct<axis:string,op:string,words:array<string>,source:string>>"


class Pattern(NamedTuple):
    """One line of the caller's table: an axis, what its match means, and a regular expression.

    lane is state (searched in the whole label, the match is the value), noun (in the last line, the match is the value), operator
    (in the last line, what follows the match is the value) or quantity (in the whole label, a gate without a value).
    """

    axis: str
    lane: str
    pattern: str

    @property
    def any_case(self) -> str:
        return f"(?is)(?:{self.pattern})"

    @property
    def groups(self) -> int:
        return re.compile(self.pattern).groups


def _words(text: Column) -> Column:
    return F.array_distinct(F.transform(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), stem))


def label_parts(labels: DataFrame) -> DataFrame:
    """(family, code, whole, leaf, positive, leaf_positive, ancestor, above, common, residual) of labels (family, code, label).

    " ; " with blanks parts the lines of a label, the last is the code's own (leaf). Optional clauses are masked; positive leaves
    denials out. above: stems of the lines above that no leaf of the family holds. common: stems that more than half of the
    family's other codes hold, so that they tell no code from another.
    """
    lines = F.filter(F.transform(F.split(F.coalesce("label", F.lit("")), " ; "), lambda x: F.trim(F.regexp_replace(x, OPTIONAL_CLAUSE, "$1"))), lambda x: x != "")
    l = labels.select("family", "code", "label", lines.alias("lines"))
    l = l.select("family", "code", "label", F.array_join("lines", " ; ").alias("whole"), F.coalesce(F.try_element_at("lines", F.lit(-1)), F.lit("")).alias("leaf"), F.array_join(F.slice("lines", 1, F.greatest(F.size("lines") - 1, F.lit(0))), " ; ").alias("ancestor"))
    deny = lambda c: F.regexp_replace(c, DENIAL, " ")
    held = l.select("family", "code", F.explode(_words(F.col("label"))).alias("word"))
    sizes = l.groupBy("family").agg(F.count(F.lit(1)).alias("n"))
    df = held.groupBy("family", "word").agg(F.count(F.lit(1)).alias("df")).join(sizes, "family")
    # a holder sees df - 1 of its n - 1 siblings, another code sees df of them, but asks about its own words only
    common = df.where("2 * (df - 1) > greatest(1, n - 1)").groupBy("family").agg(F.collect_set("word").alias("common"))  # fewer than twice a label's words
    above = l.select("family", "code", F.explode(_words(F.col("ancestor"))).alias("word")).join(l.select("family", F.explode(_words(F.col("leaf"))).alias("word")).distinct(), ["family", "word"], "left_anti")
    above = above.groupBy("family", "code").agg(F.collect_set("word").alias("above"))
    none = F.array().cast("array<string>")
    j = l.join(above, ["family", "code"], "left").join(common, "family", "left")
    return j.select(
        "family", "code", "whole", "leaf", deny("whole").alias("positive"), deny("leaf").alias("leaf_positive"), "ancestor",
        F.coalesce("above", none).alias("above"), F.coalesce("common", none).alias("common"), is_residual(F.col("leaf")).alias("residual"),
    )


def _before(text: Column, p: Pattern) -> Column:
    """The text before the pattern's first match, unless it matches at once or not at all."""
    head = F.regexp_extract(text, rf"(?is)^(.*?)(?:{p.pattern})", 1)
    return F.when(head != "", head).otherwise(text)


def _of_quantity(said: Column) -> Column:
    """Whether a denial compares quantities: headed by a comparison, or of words of quantities alone."""
    words = F.filter(_words(said), lambda w: F.length(w) >= 3)
    head = F.get(F.split(F.lower(F.trim(said)), r"\s+"), 0)
    return (F.size(words) > 0) & (head.isin(*QUANTITY_HEADS) | F.forall(words, lambda w: w.isin(*QUANTITY_WORDS)))


def typed_conditions(parts: DataFrame, patterns: list[Pattern], stop: list[str], states: list[str]) -> DataFrame:
    """(family, code, axis, op, words, source) of label_parts: what the caller's patterns find in the labels of codes that are not residual.

    A value is the phrases of the match, or for operators of the WINDOW after it, up to the next ";", "." or state word; words of
    stop and common words are none, and outside the state lane those of the lines above and of states. A phrase that a state
    pattern covers wholly moves to that pattern's axis. A quantity is a gate, also one that the leaf denies ("not more than").
    """
    state = [p for p in patterns if p.lane == "state"]
    lit = lambda ws: F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>")
    # step by step in columns of their own, so that no step is written into the next one more than once
    spans, units, owners, rows = {}, {}, {}, []
    for k, p in enumerate(patterns):
        text = F.col("positive" if p.lane in ("state", "quantity") else "leaf_positive")
        spans[f"m{k}"] = F.regexp_extract(text, p.any_case, 0)
        if p.lane == "operator":
            after = F.regexp_extract(text, rf"{p.any_case}(.{{0,{WINDOW}}})", p.groups + 1)
            after = F.when((F.length(after) == WINDOW) & after.rlike(r" .*\S$"), F.regexp_replace(after, r" [^ ]*$", "")).otherwise(after)
            spans[f"s{k}"] = F.split_part(F.split_part(after, F.lit(";"), F.lit(1)), F.lit("."), F.lit(1))
        elif p.lane != "quantity":
            spans[f"s{k}"] = F.col(f"m{k}")
    t = parts.where("NOT residual").withColumns({"idle": F.array_distinct(F.concat(lit(stop), "common"))}).withColumns({"idle_noun": F.array_distinct(F.concat("idle", "above", lit(states)))})
    t = t.withColumns({c: e for c, e in spans.items() if c[0] == "m"}).withColumns({c: e for c, e in spans.items() if c[0] == "s"})
    for q in state:
        t = t.withColumns({f"s{k}": _before(F.col(f"s{k}"), q) for k, p in enumerate(patterns) if p.lane == "operator"})
    none = F.lit(None).cast("array<string>")
    struct = lambda axis, op, words, source: F.struct(axis.alias("axis"), F.lit(op).alias("op"), words.alias("words"), source.alias("source"))
    gated = F.lit(False)
    for k, p in enumerate(patterns):
        if p.lane == "quantity":
            gated = gated | (F.col(f"m{k}") != "")
            rows.append(F.array(F.when(F.col(f"m{k}") != "", struct(F.lit(p.axis), "quant_gate", none, F.col("whole")))))
            continue
        units[f"u{k}"] = phrase_units(F.col(f"s{k}"), F.col("idle" if p.lane == "state" else "idle_noun"))
        source = F.concat(f"m{k}", f"s{k}") if p.lane == "operator" else F.col(f"m{k}")
        if p.lane == "state":
            rows.append(F.array(struct(F.lit(p.axis), "has_token", F.col(f"u{k}"), source)))
            continue
        owned = lambda u, p=p: F.coalesce(*[F.when(u.rlike(rf"(?i)^(?:{q.pattern})$"), F.lit(q.axis)) for q in state], F.lit(p.axis))
        owners[f"o{k}"] = F.transform(f"u{k}", lambda u: F.struct(owned(u).alias("axis"), u.alias("unit")))  # noqa: B023
        # own phrases in their order, those moved to another axis sorted
        mine = lambda a, k=k: F.transform(F.filter(f"o{k}", lambda o: o["axis"] == a), lambda o: o["unit"])
        rows.append(F.transform(F.array_distinct(F.transform(f"o{k}", lambda o: o["axis"])), lambda a: struct(a, "has_token", F.when(a == p.axis, mine(a)).otherwise(F.array_sort(mine(a))), source)))  # noqa: B023
    axis = next((p.axis for p in patterns if p.lane == "quantity"), "quantitative_threshold")
    denied = F.exists(F.regexp_extract_all("leaf", F.lit(DENIAL), F.lit(1)), _of_quantity)
    rows.append(F.array(F.when(~gated & denied, struct(F.lit(axis), "quant_gate", none, F.col("leaf")))))
    every = F.flatten(F.array(*[r.cast(ROW) for r in rows]))
    t = t.withColumns(units).withColumns(owners).select("family", "code", F.explode(every).alias("r"))
    return t.where("r IS NOT NULL AND (r.op = 'quant_gate' OR size(r.words) > 0)").select("family", "code", "r.*")


def qualifiers(parts: DataFrame, patterns: list[Pattern], sets: dict[str, tuple[str, list[str], list[str]]], stop: list[str]) -> DataFrame:
    """(family, code, axis, kind, words) that all codes below a heading share, or that a label names of a closed set; never scored.

    kind ancestor: phrases of the lines above, unless they are residual. Each of sets, by kind: (axis, axes whose patterns search,
    words of the set): the stems of all matches in the positive label that are in the set, sorted.
    """
    none = F.array().cast("array<string>")
    units = phrase_units(F.regexp_replace("ancestor", DENIAL, " "), F.array(*[F.lit(w) for w in stop]) if stop else none)
    struct = lambda axis, kind, ws: F.struct(F.lit(axis).alias("axis"), F.lit(kind).alias("kind"), ws.alias("words"))
    found = [F.when((F.col("ancestor") != "") & ~is_residual(F.col("ancestor")), struct("product_identity", "ancestor", units))]
    for kind, (axis, axes, words) in sets.items():
        every = F.concat(none, *[F.regexp_extract_all("positive", F.lit(p.any_case), F.lit(0)) for p in patterns if p.axis in axes])
        own = F.array_intersect(F.transform(every, lambda m: stem(F.lower(m))), F.array(*[F.lit(w) for w in words]))
        # a set qualifies codes that are told apart, so not those of what is left over
        found.append(F.when(~F.col("residual"), struct(axis, kind, F.array_sort(own))))
    q = parts.select("family", "code", F.explode(F.array_compact(F.array(*found))).alias("q")).select("family", "code", "q.*")
    return q.where(F.size("words") > 0)


def fallback_identity(parts: DataFrame, typed: DataFrame, labels: DataFrame, patterns: list[Pattern], stop: list[str], states: list[str], identity: tuple[str, ...] = ("product_identity", "species_source")) -> DataFrame:
    """(family, code, axis, words, alt_group, grade) for codes that no row of typed names an identity for.

    The phrases of the leaf without the words of typed rows, of the lines above, of states and of stop, one row for each group of
    alternatives (labels as label_parts got them), grade fallback. A code still without any row whose leaf is one or two telling
    words takes them on the axis of the first pattern whose match holds them all, grade named.
    """
    lit = lambda ws: F.array(*[F.lit(w) for w in ws]) if ws else F.array().cast("array<string>")
    none = F.array().cast("array<string>")
    own = F.flatten(F.transform(F.coalesce("words", none), lambda u: F.split(u, " ")))
    known = typed.groupBy("family", "code").agg(F.bool_or(F.col("axis").isin(*identity)).alias("named"), F.array_distinct(F.flatten(F.collect_list(own))).alias("own"))  # words of one code's rows
    open_ = parts.where("NOT residual").join(known, ["family", "code"], "left").where("NOT coalesce(named, false)").withColumn("typed", F.col("own").isNotNull()).withColumn("own", F.coalesce("own", none))
    o = open_.withColumn("idle", F.array_distinct(F.concat(lit(stop), "common", "above", "own", lit(states)))).withColumn("units", phrase_units(F.col("leaf_positive"), F.col("idle")))
    key = F.struct("family", "code")
    values = o.select(key.alias("code"), F.posexplode("units").alias("row_id", "value"))
    grouped = group_values(values, alternation_atoms(labels.select(key.alias("code"), "label")))
    grp = F.regexp_extract("alt_group", r":([gs]\d+)$", 1)
    rows = grouped.groupBy("code", grp.alias("alt_group")).agg(F.array_sort(F.collect_list(F.struct("row_id", "value"))).alias("v"))
    fallback = rows.select("code.*", F.lit("product_identity").alias("axis"), F.col("v.value").alias("words"), "alt_group", F.lit("fallback").alias("grade"))

    words = F.array_sort(F.filter(_words(F.col("leaf_positive")), lambda w: F.length(w) >= 3))
    left = o.where("NOT typed").where(F.size("units") == 0).withColumn("words", words).where((F.size("words") > 0) & (F.size("words") <= 2) & ~F.arrays_overlap("words", F.concat("common", "above")))
    first = F.coalesce(*[F.when(F.size(F.array_except("words", _words(F.regexp_extract("leaf_positive", p.any_case, 0)))) == 0, p.axis) for p in patterns if p.lane != "quantity"], F.lit(None).cast("string"))
    last = left.select("family", "code", first.alias("axis"), "words", F.lit("").alias("alt_group"), F.lit("named").alias("grade")).where("axis IS NOT NULL")
    return fallback.unionByName(last)


def _note_units(text: Column, most: int, idle: list[str]) -> Column:
    """The first `most` distinct phrases of a note, each the first three stems of its words of three or more characters."""

    def unit(part: Column) -> Column:
        words = F.filter(F.regexp_extract_all(F.lower(part), F.lit("[a-z0-9]+"), F.lit(0)), lambda w: (F.length(w) >= 3) & ~w.isin(*idle))
        return F.array_join(F.slice(F.transform(words, stem), 1, 3), " ")

    return F.slice(F.array_distinct(F.filter(F.transform(F.split(text, r"[,;:()]|\bor\b|\band\b"), unit), lambda u: u != "")), 1, most)


def note_conditions(notes: DataFrame, parts: DataFrame, idle: list[str]) -> DataFrame:
    """(family, code, kind, phrase, place) of notes (code, kind, pos, text) for label_parts: exclusion or inclusion, in order of the notes.

    From the first four notes of a kind that excludes (note_excl, then rule_excl): phrases of two or more words that share none
    with the code's own leaf and are not all of quantities, at most four for a code once a kind is read (a kind ends its reading
    with the note that reaches four). From the first two note_incl: three phrases, residual codes excepted. Words of idle are none.
    """
    n = notes.where("text IS NOT NULL").groupBy("code", "kind").agg(F.array_sort(F.collect_list(F.struct("pos", "text"))).alias("t"))  # a code's notes of a kind
    own = parts.select("family", "code", "residual", F.filter(_words(F.col("leaf")), lambda w: F.length(w) >= 3).alias("leaf_words"))
    g = n.groupBy("code").agg(*[F.max(F.when(F.col("kind") == k, F.col("t.text"))).alias(k) for k in ("note_excl", "rule_excl", "note_incl")])
    j = own.join(g, "code")
    telling = lambda u: (F.size(F.split(u, " ")) >= 2) & ~F.arrays_overlap(F.split(u, " "), "leaf_words") & ~F.forall(F.split(u, " "), lambda w: w.isin(*QUANTITY_WORDS))
    none = F.array().cast("array<string>")

    def denied(kind: str) -> Column:
        per_note = F.transform(F.slice(F.coalesce(kind, F.array().cast("array<string>")), 1, 4), lambda t: F.flatten(F.transform(F.regexp_extract_all(t, F.lit(EXCLUDES), F.lit(1)), lambda m: F.filter(_note_units(m, 2, idle), telling))))
        return per_note

    def read(seen: Column, kind: str) -> Column:
        # a note is read unless an earlier one of its kind has already filled the four; the first of a kind always is
        step = lambda s, t: F.when(s["full"], s).otherwise(
            F.struct(F.array_distinct(F.concat(s["seen"], t)).alias("seen"), (F.size(F.array_distinct(F.concat(s["seen"], t))) >= 4).alias("full"))
        )
        return F.aggregate(denied(kind), F.struct(seen.alias("seen"), F.lit(False).alias("full")), step, lambda s: s["seen"])

    j = j.withColumn("excl", read(none, "note_excl")).withColumn("excl", read(F.col("excl"), "rule_excl"))
    incl = F.slice(F.array_distinct(F.flatten(F.transform(F.slice(F.coalesce("note_incl", none), 1, 2), lambda t: _note_units(t, 3, idle)))), 1, 3)
    kinds = F.array(F.struct(F.lit("exclusion").alias("kind"), F.col("excl").alias("u")), F.struct(F.lit("inclusion").alias("kind"), F.when(~F.col("residual"), incl).alias("u")))
    return j.select("family", "code", F.inline(kinds)).select("family", "code", "kind", F.posexplode("u").alias("place", "phrase"))
