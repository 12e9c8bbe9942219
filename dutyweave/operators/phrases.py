"""Phrases of legal labels and of rulings, and the conditions made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.functions.text import fold_spaces, stem
from dutyweave.staging import meet

# fixed values: how a label denies, the heads that make a denial a quantity, the words that do if there are no others, and how an optional clause begins and what ends it
DENIAL = r"(?i)\b(?:other\s+than|excluding|except|does\s+not\s+include|not\s+including|not\s+containing|without|no|not)\s+([a-z][a-z ,\-]{2,60}[a-z]*)"
QUANTITY_HEADS = ("more", "less", "exceeding")
QUANTITY_WORDS = (
    "more", "less", "than", "exceed", "exceeding", "least", "most", "over", "under", "weigh", "weighing", "contain", "containing",
    "and", "the", "for", "with", "not", "its", "this", "that", "but",
)
OPTIONAL_CLAUSE = r"(?i)\bwhether\s+or\s+not\b.*?(,\s*such\s+as\b|$)"


def phrase_units(text: Column, leave_out: Column, most: int = 8) -> Column:
    """Phrases of a label: parts between punctuation, "and" and "or"; of each the first four stems that are not left out; then single capitals."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[,;:()]|\band\b|\bor\b")

    def unit(part: Column) -> Column:
        stems = F.transform(F.regexp_extract_all(part, F.lit(r"[a-z0-9]+"), F.lit(0)), stem)
        return F.array_join(F.slice(F.filter(stems, lambda w: (F.length(w) >= 3) & ~F.array_contains(leave_out, w)), 1, 4), " ")

    signs = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\w.])([A-Z])(?![\w.])"), F.lit(1)), F.lower)
    units = F.filter(F.transform(parts, unit), lambda u: u != "")
    return F.slice(F.array_distinct(F.concat(units, F.filter(signs, lambda c: ~F.array_contains(leave_out, c)))), 1, most)


def exclusions(labels: DataFrame) -> DataFrame:
    """(code, kind, words) denied in a label's last part: up to four sorted stems; a denial of other headings is skipped.

    One headed by a comparison, or of words of quantities alone, is a quantity. What "whether or not" leaves open is not denied.
    """
    leaf = F.regexp_replace(F.element_at(F.split("label", ";"), -1), OPTIONAL_CLAUSE, "$1")
    said = labels.select("code", F.explode(F.regexp_extract_all(leaf, F.lit(DENIAL), F.lit(1))).alias("said"))
    said = said.where(~F.col("said").rlike(r"(?i)\bof\s+(?:heading|chapter)s?\b"))
    words = F.transform(F.regexp_extract_all(F.lower("said"), F.lit(r"[a-z0-9]+"), F.lit(0)), stem)
    words = F.slice(F.array_sort(F.array_distinct(F.filter(words, lambda w: F.length(w) >= 3))), 1, 4)
    head = F.element_at(F.split(F.lower(F.trim("said")), r"\s+"), 1)
    found = said.select("code", F.when(head.isin(*QUANTITY_HEADS) | F.forall(words, lambda w: w.isin(*QUANTITY_WORDS)), "quantity").otherwise("exclusion").alias("kind"), words.alias("words"))
    return found.where(F.size("words") > 0).distinct()


def ruling_phrases(rulings: DataFrame, ancestors: DataFrame, most: int = 4) -> DataFrame:
    """(code, phrase, n, refs) of rulings (ref, code, family, phrase): the commonest phrases that tell a code from its family.

    A phrase of more than half of the family's codes with rulings, or wholly of its ancestors' words (code, word), is none.
    """
    codes = rulings.groupBy("family").agg(F.countDistinct("code").alias("codes"))
    spread = rulings.groupBy("family", "phrase").agg(F.countDistinct("code").alias("holders"))
    telling = spread.join(codes, "family").where("holders * 2 <= codes").select("family", "phrase")
    counted = rulings.join(telling, ["family", "phrase"]).groupBy("code", "phrase").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_set("ref")).alias("refs"))
    words = counted.select("code", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("word"))
    own = words.join(ancestors.distinct(), ["code", "word"], "left_anti").select("code", "phrase").distinct()
    order = Window.partitionBy("code").orderBy(F.desc("n"), "phrase")
    best = counted.join(own, ["code", "phrase"], "left_semi").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return best.select("code", "phrase", "n", F.array_join(F.slice("refs", 1, 4), ",").alias("refs"))


def pair_conditions(words: DataFrame) -> DataFrame:
    """(code, first, second) of words (family, code, word, leaf): for each code the first pair of its words, rarest first, one of the leaf, that no sibling holds together.

    All joins are of rows that grow with the words, so none is broadcast.
    """
    held = words.groupBy("family", "word").agg(F.countDistinct("code").alias("n"))
    w = words.groupBy("family", "code", "word").agg(F.bool_or("leaf").alias("leaf"))
    w = meet(w, held, ["family", "word"])
    a, b = F.struct("n", "word"), F.struct(F.col("m").alias("n"), F.col("other").alias("word"))
    pairs = meet(w, w.select("family", "code", F.col("word").alias("other"), F.col("leaf").alias("other_leaf"), F.col("n").alias("m")), ["family", "code"]).where((a < b) & (F.col("leaf") | F.col("other_leaf")))
    alone = meet(w, w.select("family", "code", F.col("word").alias("other")), ["family", "code"]).where("word <> other").groupBy("family", "word", "other").agg(F.count(F.lit(1)).alias("holders")).where("holders = 1")
    free = meet(pairs, alone.select("family", "word", "other"), ["family", "word", "other"])
    best = free.groupBy("code").agg(F.min(F.struct("n", "word", "m", "other")).alias("p"))
    return best.select("code", F.col("p.word").alias("first"), F.col("p.other").alias("second"))


def ruling_index(chunks: DataFrame, most: int = 12) -> DataFrame:
    """Cases (code, country, ref, phrases) of chunks (ref, code, country, phrases): equal phrase sets once, phrases of one reference merged."""
    merged = chunks.select("ref", "code", "country", F.explode("phrases").alias("phrase")).distinct().groupBy("ref", "code", "country").agg(F.slice(F.array_sort(F.collect_set("phrase")), 1, most).alias("phrases"))
    return merged.groupBy("code", "country", "phrases").agg(F.min("ref").alias("ref"))


def index_statistics(cases: DataFrame) -> DataFrame:
    """For each word of the cases: how many hold it, with the number of cases and their mean number of words."""
    words = cases.select("code", "country", "ref", F.array_distinct(F.flatten(F.transform("phrases", lambda p: F.split(p, " ")))).alias("words"))
    whole = words.agg(F.count(F.lit(1)).alias("n_cases"), F.round(F.avg(F.size("words")), 6).alias("mean_words"))
    df = words.select(F.explode("words").alias("word")).groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    return df.join(F.broadcast(whole))  # one row


def usable_rulings(rulings: DataFrame) -> DataFrame:
    """Rulings that may serve: not rejected or invalid, in force, with a code and words; the summary falls back to the keywords."""
    text = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
    cn8 = F.left(F.regexp_replace(text("cn8"), r"\D", ""), F.lit(8))
    words = F.array_distinct(F.filter(F.regexp_extract_all(F.lower(text("keywords")), F.lit(r"[a-z0-9]+"), F.lit(0)), lambda w: F.length(w) >= 3))
    kept = rulings.where(~F.lower(text("quality_status")).isin("rejected", "invalid") & F.upper(text("status")).isin("", "VALID"))
    kept = kept.select(F.left(text("ref"), F.lit(40)).alias("ref"), cn8.alias("cn8"), F.size(words).alias("n_words"), F.left(F.coalesce(F.nullif(text("summary"), F.lit("")), F.concat(F.lit("keywords: "), F.lower(text("keywords")))), F.lit(800)).alias("summary"))
    return kept.where("cn8 <> '' AND n_words > 0")


def chapter_cards(chapters: DataFrame, limits: dict[str, int], fallback: dict[str, str]) -> DataFrame:
    """Cards in order of chapter: each column of limits with blanks folded and clipped, its fallback column where it is empty."""
    value = lambda c: F.nullif(fold_spaces(F.col(c).cast("string")), F.lit(""))
    cols = [F.left(F.coalesce(value(c), value(fallback[c]) if c in fallback else F.lit(None), F.lit("")), F.lit(n)).alias(c) for c, n in limits.items()]
    return chapters.select("chapter", *cols).orderBy("chapter")
