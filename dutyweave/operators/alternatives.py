"""Alternatives of a legal label, and lists of ingredients: both are cut by brackets and separators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutyweave.operators.phrases import OPTIONAL_CLAUSE

# fixed values: a list of alternatives in brackets, what stands between alternatives, and what ends a list of them
LIST_IN_BRACKETS = r"(?i)\(([^()]*\bor\b[^()]*)\)"
BETWEEN = r"(?i)\s+or\s+"
ENDS = r"[,;:()]"
PERCENT = r"(\d+(?:[.,]\d+)?)\s*%"


def alternation_atoms(parts: DataFrame) -> DataFrame:
    """(code, grp, place, atom) of parts (code, label): the alternatives that a label names, each with its group.

    Lists with "or" in brackets come first, then runs of "or" outside them, each run from the separator before its first to the one
    after its last, then the parts of the last line of the label that ";" separates (s0); " ; " with blanks separates lines. What
    "whether or not" leaves open is none.
    """
    mask = lambda c: F.trim(F.regexp_replace(c, OPTIONAL_CLAUSE, "$1"))
    lines = F.transform(F.split("label", " ; "), mask)
    text = F.array_join(F.filter(lines, lambda x: x != ""), " ; ")
    cut = lambda c: F.transform(F.split(c, BETWEEN), lambda a: F.lower(F.trim(a)))
    inside = F.filter(F.transform(F.regexp_extract_all(text, F.lit(LIST_IN_BRACKETS), F.lit(1)), cut), lambda a: F.size(a) >= 2)
    # brackets without alternatives only separate
    pieces = F.filter(F.split(F.regexp_replace(text, LIST_IN_BRACKETS, ","), ENDS), lambda p: p.rlike(BETWEEN))
    runs = F.filter(F.transform(pieces, lambda p: F.filter(cut(p), lambda a: a != "")), lambda a: F.size(a) >= 2)
    several = F.transform(F.concat(inside, runs), lambda a, i: F.struct(F.concat(F.lit("g"), i.cast("string")).alias("grp"), a.alias("atoms")))
    last = F.filter(F.transform(F.split(F.element_at(lines, -1), ";"), lambda p: F.lower(F.trim(F.regexp_replace(p, r"^[ ,.]+|[ ,.]+$", "")))), lambda p: p != "")
    told = F.when(F.size(last) >= 2, F.array(F.struct(F.lit("s0").alias("grp"), last.alias("atoms"))))
    every = F.concat(several, F.coalesce(told, F.array().cast("array<struct<grp:string,atoms:array<string>>>")))
    g = parts.where("label IS NOT NULL").select("code", F.posexplode(every).alias("k", "g")).select("code", "k", "g.grp", F.posexplode("g.atoms").alias("j", "atom"))
    return g.where("atom <> ''").select("code", "grp", (F.col("k") * 1000 + F.col("j")).alias("place"), "atom")


def group_values(values: DataFrame, atoms: DataFrame) -> DataFrame:
    """values (code, row_id, value, ...) with alt_group: the group, of its code, of the first atom that contains the value, else of the first that contains all its words of three or more characters; else empty."""
    said = F.lower(F.trim("value"))
    words = F.filter(F.split(said, r"\s+"), lambda w: F.length(w) >= 3)
    whole = (said != "") & F.contains("atom", said)
    split_up = (F.size(words) > 0) & F.forall(words, lambda w: F.contains(F.col("atom"), w))
    met = values.select("code", "row_id", "value").join(atoms, "code").where(whole | split_up)
    best = met.groupBy("code", "row_id").agg(F.min(F.struct((~whole).alias("far"), "place", "grp")).alias("b"))
    joined = values.join(best, ["code", "row_id"], "left")
    return joined.withColumn("alt_group", F.coalesce(F.concat(F.col("code").cast("string"), F.lit(":"), F.col("b.grp")), F.lit(""))).drop("b")


def _pieces(text: Column) -> Column:
    """array<struct<segment, depth, piece>>: the text between brackets and top-level commas, with its bracket depth, in order."""
    tokens = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"[(\[{)\]},，、]|[^(\[{)\]},，、]+"), F.lit(0))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("segment"), F.array().cast("array<struct<segment:int,depth:int,piece:string>>").alias("out"))

    def step(s: Column, t: Column) -> Column:
        opens, closes = t.isin("(", "[", "{"), t.isin(")", "]", "}")
        ends = t.isin(",", "，", "、") & (s["depth"] == 0)
        depth = F.when(opens, s["depth"] + 1).when(closes, F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        piece = F.struct(s["segment"].alias("segment"), s["depth"].alias("depth"), t.alias("piece"))
        out = F.when(opens | closes | ends, s["out"]).otherwise(F.concat(s["out"], F.array(piece)))
        return F.struct(depth.alias("depth"), (s["segment"] + ends.cast("int")).alias("segment"), out.alias("out"))

    return F.aggregate(tokens, start, step, lambda s: s["out"])


def _segments(texts: DataFrame, origin: str, nutrition: str) -> DataFrame:
    """(text_id, segment, name, top, nested, reason): a segment's top-level words, the percents at its top level and in its brackets, in order, and why the former are none of an ingredient."""
    p = texts.select("text_id", F.posexplode(_pieces(F.col("text"))).alias("k", "p")).select("text_id", "k", "p.*")
    found = F.transform(F.regexp_extract_all("piece", F.lit(PERCENT), F.lit(1)), lambda x: F.regexp_replace(x, ",", ".").cast("double"))
    own = F.struct("k", "piece", found.alias("percents"))
    g = p.groupBy("text_id", "segment").agg(
        F.array_sort(F.collect_list(F.when(F.col("depth") == 0, own))).alias("t"), F.array_sort(F.collect_list(F.when(F.col("depth") > 0, own))).alias("n"), F.max(F.trim("piece") != "").alias("some")
    )
    name = F.regexp_replace(F.array_join(F.transform("t", lambda x: x["piece"]), " "), PERCENT, " ")
    name = F.regexp_replace(F.trim(F.regexp_replace(name, r"\s+", " ")), r"^[ ,:/·-]+|[ ,:/·-]+$", "")
    reason = F.when(name.rlike(nutrition), "nutrition").when(name.rlike(origin), "origin")
    return g.where("some").select("text_id", "segment", name.alias("name"), F.flatten(F.col("t.percents")).alias("top"), F.flatten(F.col("n.percents")).alias("nested"), reason.alias("reason"))


def split_ingredients(texts: DataFrame, origin: str, nutrition: str) -> DataFrame:
    """(text_id, segment, name, percent) of texts (text_id, text) cut at commas outside brackets: the first percent outside brackets, unless the name says origin or nutrition."""
    s = _segments(texts, origin, nutrition)
    return s.select("text_id", "segment", "name", F.when(F.col("reason").isNull(), F.try_element_at("top", F.lit(1))).alias("percent"))


def excluded_percents(texts: DataFrame, origin: str, nutrition: str) -> DataFrame:
    """(text_id, segment, percent, reason) of all percents that split_ingredients leaves out: nested, nutrition, origin, or repeated."""
    s = _segments(texts, origin, nutrition)
    rest = F.when(F.col("reason").isNull(), F.slice("top", 2, 1 << 20)).otherwise(F.col("top"))
    left = s.select("text_id", "segment", F.explode(rest).alias("percent"), F.coalesce("reason", F.lit("repeated")).alias("reason"))
    return left.unionByName(s.select("text_id", "segment", F.explode("nested").alias("percent"), F.lit("nested").alias("reason")))
