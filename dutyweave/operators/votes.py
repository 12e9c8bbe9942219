"""Votes of rulings, main ingredients, forms by likeness of names, titles and derived states."""

from __future__ import annotations

from dutyweave.operators.classes import representatives, to_members
from dutyweave.operators.classify import bm25_shortlist
from dutyweave.operators.containment import contained
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: words of names, generic ones among them, noise of a looked-up name, states that say nothing of cooking, chapters of raw goods
NAME_WORDS = r"[가-힣A-Za-z]{2,}"
GENERIC = ["냉동", "국산", "간편", "이유식용", "프리미엄", "오리지널"]
MEASURE_NOISE = r"(?i)\b\d+(?:\.\d+)?\s*(?:g|kg|ml|l|mm|cm|개입|팩|종|인분)\b"
RELATION_NOISE = r"(?:^|\s)(?:이상|이하|미만|초과|택\s*1|택1)(?=\s|$)"
LONE_SIGN = r"(?<!\S)[A-Za-z×*+&/-](?!\S)"
OPEN_STATES = ["", "unknown", "raw", "fresh", "uncooked", "frozen", "chilled"]
LAST_RAW_CHAPTER = 14


def precedent_vote(queries: DataFrame, rulings: DataFrame, codes: DataFrame, k: int = 2, shortlist: int = 20) -> DataFrame:
    """(product, code, silence, n_refs, refs, words): the one code of the shortlisted rulings that have a phrase wholly in the product's words.

    queries: product, prefix, toks; rulings: ref, prefix, code, toks, phrases; codes: code. Scores only make the shortlist. Without
    exactly one code that exists and k rulings the code is empty, and silence tells why.
    """
    queries, members = representatives(queries.select("product", "prefix", "toks"), "product")  # equal queries get one answer
    short = bm25_shortlist(queries, rulings, shortlist)
    asked = queries.groupBy("product").agg(F.array_distinct(F.flatten(F.collect_list("toks"))).alias("asked"))
    met = short.join(rulings.select("ref", "code", "phrases"), "ref").join(asked, "product")
    full = F.filter("phrases", lambda p: (p != "") & (F.size(F.array_except(F.split(p, " "), F.col("asked"))) == 0))
    met = met.select("product", "ref", "code", "place", full.alias("full"))
    is_hit = F.size("full") > 0
    votes = met.groupBy("product").agg(
        F.count_if(is_hit).alias("hits"),
        F.countDistinct(F.when(is_hit, F.col("code"))).alias("n_codes"),
        F.min(F.when(is_hit, F.col("code"))).alias("code"),
        F.countDistinct(F.when(is_hit, F.col("ref"))).alias("n_refs"),
        F.transform(F.slice(F.array_sort(F.collect_list(F.when(is_hit, F.struct("place", "ref")))), 1, 4), lambda x: x["ref"].cast("string")).alias("refs"),
        F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("full")))), 1, 6).alias("phrases"),
    )
    known = codes.select("code", F.lit(True).alias("exists")).distinct()
    v = asked.select("product").join(votes, "product", "left").join(known, "code", "left")
    silence = (
        F.when(F.col("hits").isNull(), "no_lexical_overlap").when(F.col("hits") == 0, "no_phrase_match").when(F.col("n_codes") > 1, "distribution_split")
        .when(F.col("exists").isNull(), "not_in_tree").when(F.col("n_refs") < k, "k_below_min").otherwise("")
    )
    words = F.slice(F.array_sort(F.array_distinct(F.flatten(F.transform("phrases", lambda p: F.split(p, " "))))), 1, 8)
    answers = v.withColumn("silence", silence).select(
        "product", F.when(F.col("silence") == "", F.col("code")).otherwise("").alias("code"), "silence", F.coalesce("n_refs", F.lit(0)).alias("n_refs"),
        F.array_join(F.coalesce("refs", F.array().cast("array<string>")), ",").alias("refs"), F.array_join(F.coalesce(words, F.array().cast("array<string>")), ",").alias("words"),
    )
    return to_members(answers, members, "product").select(answers.columns)


def _signs(text: Column) -> Column:
    """English words of three or more letters and pairs of neighbouring syllables."""
    low = F.lower(F.coalesce(text, F.lit("")))
    syllables = F.regexp_replace(low, "[^가-힣]", "")
    pairs = F.when(F.length(syllables) > 1, F.transform(F.sequence(F.lit(1), F.length(syllables) - 1), lambda i: F.substring(syllables, i, F.lit(2))))
    return F.array_distinct(F.concat(F.regexp_extract_all(low, F.lit("[a-z]{3,}"), F.lit(0)), F.coalesce(pairs, F.array().cast("array<string>"))))


def pick_principal(candidates: DataFrame, facts: DataFrame, entries: DataFrame, least: float = 10.0) -> DataFrame:
    """(product, principal, way): the first of candidates (product, pos, name) that shares a word or syllable pair with facts (product, text).

    Else the largest percent of entries (product, name, percent) that hold a candidate's name, where two or more reach `least`.
    """
    said = facts.select("product", F.explode(_signs(F.col("text"))).alias("sign")).distinct()
    met = candidates.select("product", "pos", "name", F.explode(_signs(F.col("name"))).alias("sign")).join(said, ["product", "sign"], "left_semi")
    first = met.groupBy("product").agg(F.min_by("name", "pos").alias("by_identity"))
    names = candidates.groupBy("product").agg(F.collect_set("name").alias("names"))
    large = entries.where(F.col("percent") >= least).join(names, "product").where(F.exists("names", lambda n: F.col("name").contains(n)))
    most = large.groupBy("product").agg(F.max_by("name", F.struct("percent", "name")).alias("by_percent"), F.count(F.lit(1)).alias("n")).where("n >= 2")
    j = names.join(first, "product", "left").join(most, "product", "left")
    way = F.when(F.col("by_identity").isNotNull(), "identity").when(F.col("by_percent").isNotNull(), "percent").otherwise("none")
    return j.select("product", F.coalesce("by_identity", "by_percent", F.lit("")).alias("principal"), way.alias("way"))


def like_forms(products: DataFrame, keys: DataFrame, least: int = 2) -> DataFrame:
    """(product, key, score) of products (product, name) and keys (key): the key that most of the name's words contain or are contained in, `least` at least.

    Pairs of words are found once over the distinct words, where the rarest gram of the contained one is.
    """

    def words(name: Column) -> Column:
        return F.explode(F.array_except(F.array_distinct(F.regexp_extract_all(F.coalesce(name, F.lit("")), F.lit(NAME_WORDS), F.lit(0))), F.array(*[F.lit(g) for g in GENERIC])))

    p, members = representatives(products.select("product", words(F.col("name")).alias("word")), "product")  # names of equal words meet the keys once
    q = keys.select("key").distinct().select("key", words(F.col("key")).alias("other"))
    ours, theirs = p.select("word").distinct(), q.select("other").distinct()
    inside = contained(theirs.withColumnRenamed("other", "text"), ours.withColumnRenamed("word", "needle")).select(F.col("needle").alias("word"), F.col("text").alias("other"))
    around = contained(ours.withColumnRenamed("word", "text"), theirs.withColumnRenamed("other", "needle")).select(F.col("text").alias("word"), F.col("needle").alias("other"))
    alike = inside.unionByName(around).distinct()
    met = p.join(alike, "word").join(q, "other").select("product", "key", "word").distinct().groupBy("product", "key").agg(F.count(F.lit(1)).alias("score"))
    best = met.where(F.col("score") >= least).groupBy("product").agg(F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("b"))
    return to_members(best.select("product", "b.key", (-F.col("b.s")).alias("score")), members, "product").select("product", "key", "score")


def looked_up_names(name: Column, most: int = 4) -> Column:
    """A name without brackets, measures and lone signs, then its endings of fewer words, `most` in all."""
    cleaned = F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), r"\[[^\]]+\]", " "), r"\([^)]*\)", " ")
    for noise in (MEASURE_NOISE, RELATION_NOISE, LONE_SIGN):
        cleaned = F.regexp_replace(cleaned, noise, " ")
    cleaned = F.btrim(F.regexp_replace(cleaned, r"\s+", " "), F.lit(" -_/|"))
    words = F.filter(F.split(cleaned, " "), lambda w: F.length(w) >= 2)
    endings = F.transform(F.filter(F.sequence(F.lit(0), F.size(words)), lambda i: (i > 0) & (i < F.size(words))), lambda i: F.array_join(F.slice(words, i + 1, F.size(words)), " "))
    return F.slice(F.array_distinct(F.concat(F.array(cleaned), endings)), 1, most)


def derive_uncooked(products: DataFrame, articles: DataFrame, chapters: DataFrame, cooking: list[str]) -> DataFrame:
    """products with derived: a state left open, no cooking word in the description, graded articles without one, and a raw chapter in front.

    products: product, state, description; articles: product, grade, text; chapters: product, chapter, score.
    """

    def cooked(text: Column) -> Column:
        return F.exists(F.array(*[F.lit(w) for w in cooking]), lambda w: F.lower(F.coalesce(text, F.lit(""))).contains(w))

    graded = articles.where(F.lower("grade").isin("strong", "medium")).groupBy("product").agg(F.bool_or(cooked(F.col("text"))).alias("_cooked"))
    front = chapters.groupBy("product").agg(F.max_by("chapter", F.struct("score", "chapter")).alias("_front"))
    j = products.join(graded, "product", "left").join(front, "product", "left")
    is_open = F.lower(F.trim(F.coalesce("state", F.lit("")))).isin(*OPEN_STATES)
    raw = F.col("_front").cast("int").between(1, LAST_RAW_CHAPTER)
    holds = is_open & ~cooked(F.col("description")) & F.coalesce(~F.col("_cooked"), F.lit(False)) & F.coalesce(raw, F.lit(False))
    return j.withColumn("derived", holds).drop("_cooked", "_front")


def gate_typed(rows: DataFrame, vocabulary: DataFrame, longest: int = 40) -> DataFrame:
    """rows (id, value) whose value has at most `longest` characters and a word of vocabulary (word); the value trimmed, in lower case."""
    value = F.lower(F.trim("value"))
    fit = rows.withColumn("value", value).where((F.length("value") > 0) & (F.length("value") <= longest))
    words = fit.select("id", F.explode(F.array_distinct(F.regexp_extract_all("value", F.lit("[a-z]+"), F.lit(0)))).alias("word"))
    return fit.join(words.join(vocabulary, "word", "left_semi"), "id", "left_semi")


def grounding_vocabulary(texts: list[DataFrame], least: int = 3) -> DataFrame:
    """Distinct words (word) of `least` or more letters of all texts (text)."""
    found = None
    for t in texts:
        part = t.select(F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z]+"), F.lit(0)))).alias("word")).where(F.length("word") >= least).distinct()
        found = part if found is None else found.unionByName(part)
    return found.distinct()


def informative(rows: DataFrame, least: int = 3) -> DataFrame:
    """rows whose text has `least` or more letters."""
    return rows.where(F.length(F.regexp_replace("text", "[^A-Za-z가-힣]", "")) >= least)


def option_words(positive: Column, negative: Column, negated: Column, operators: Column) -> Column:
    """struct(positive, negative) of a label's words: what it denies is not positive, what stays positive is not negative."""
    wanted = F.array_except(F.array_except(F.array_distinct(positive), negated), operators)
    return F.struct(F.array_sort(wanted).alias("positive"), F.array_sort(F.array_except(F.array_union(negative, negated), wanted)).alias("negative"))


def accept_titles(hits: DataFrame, words: DataFrame, blocked: str, accepted: int = 5, rejected: int = 10) -> DataFrame:
    """(product, place, title, accepted) of hits (product, pos, title, description, grade): not blocked, and strong or sharing a word with words (product, word)."""
    named = hits.where(F.trim("title") != "").withColumn("title", F.trim("title"))
    own = named.select("product", "pos", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("title"), F.lit(r"[\p{L}\p{N}]{2,}"), F.lit(0)))).alias("word"))
    grounded = own.join(words, ["product", "word"], "left_semi").select("product", "pos", F.lit(True).alias("_grounded")).distinct()
    is_blocked = F.concat_ws(" ", "title", "description").rlike(blocked)
    j = named.join(grounded, ["product", "pos"], "left").withColumn("accepted", ~is_blocked & (F.coalesce("_grounded", F.lit(False)) | (F.lower(F.coalesce("grade", F.lit(""))) == "strong")))
    once = j.groupBy("product", "accepted", "title").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("product", "accepted").orderBy("pos")
    return once.withColumn("place", F.row_number().over(order)).where(F.col("place") <= F.when(F.col("accepted"), accepted).otherwise(rejected)).select("product", "place", "title", "accepted")
