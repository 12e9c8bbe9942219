"""Text lines, fields and terms of products."""

from __future__ import annotations

from dutyweave.operators.containment import contained
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dedupe_runs(lines: DataFrame) -> DataFrame:
    """Drops a line that repeats the one before it on its page."""
    before = F.lag("line").over(Window.partitionBy("page_id").orderBy("pos"))
    return lines.withColumn("_b", before).where("_b IS NULL OR _b <> line").drop("_b")


def section(lines: DataFrame, start: str, stop: str) -> DataFrame:
    """Lines after the first that matches start, up to the first stop after it."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    t = lines.withColumn("_in", F.sum(F.col("line").rlike(start).cast("int")).over(w))
    t = t.withColumn("_out", F.sum(((F.col("_in") > 0) & F.col("line").rlike(stop)).cast("int")).over(w))
    first = F.row_number().over(Window.partitionBy("page_id", F.col("_in") > 0).orderBy("pos"))
    return t.withColumn("_k", first).where("_in > 0 AND _out = 0 AND _k > 1").drop("_in", "_out", "_k")


def fields_from_lines(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """A label line opens a field, the lines up to the next label are its value."""
    w = Window.partitionBy("page_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    known = labels.select(F.col("label").alias("line"), F.lit(True).alias("_is")).distinct()
    t = lines.join(known, "line", "left").withColumn("_g", F.sum(F.coalesce(F.col("_is").cast("int"), F.lit(0))).over(w))
    return (
        t.where("_g > 0")
        .groupBy("page_id", "_g")
        .agg(
            F.min_by("line", "pos").alias("label"),
            F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("_is").isNull(), F.struct("pos", "line")))), lambda x: x["line"]), " ").alias("value"),
        )
        .withColumnRenamed("_g", "field_no")
    )


def text_spans(texts: DataFrame) -> DataFrame:
    """(doc_id, span): the whole line, its parts at punctuation, its single words, distinct.

    Lines are brought together by document first, so only they are shuffled, and none of the spans, which are several times as long.
    """

    def spans(line: Column) -> Column:
        parts = F.transform(F.split(line, r"[,;/()]+"), lambda x: F.trim(x))
        return F.concat(F.array(F.trim(line)), parts, F.split(F.trim(line), r"\s+"))

    of_doc = texts.where("line IS NOT NULL").groupBy("doc_id").agg(F.collect_set("line").alias("lines"))
    every = F.array_distinct(F.flatten(F.transform("lines", spans)))
    return of_doc.select("doc_id", F.explode(F.filter(every, lambda x: x != "")).alias("span"))


def bigrams(term: str):
    t = F.regexp_replace(F.lower(term), r"\s+", "")
    n = F.length(t) - 1
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(t, i, F.lit(2))))).otherwise(F.array().cast("array<string>"))


def bigram_lookup(queries: DataFrame, dictionary: DataFrame, k: int = 3) -> DataFrame:
    """Dictionary terms by shared letter pairs, then Jaccard similarity; k for each query."""
    q = queries.select("query", bigrams("query").alias("g")).select("query", F.size("g").alias("nq"), F.explode("g").alias("b"))
    d = dictionary.select("term", bigrams("term").alias("g")).select("term", F.size("g").alias("nd"), F.explode("g").alias("b"))
    s = q.join(d, "b").groupBy("query", "term", "nq", "nd").agg(F.count(F.lit(1)).alias("shared"))
    s = s.withColumn("jaccard", F.round(F.col("shared") / (F.col("nq") + F.col("nd") - F.col("shared")), 6))
    order = Window.partitionBy("query").orderBy(F.desc("shared"), F.desc("jaccard"), "term")
    return s.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).select("query", "term", "shared", "jaccard", "place")


def bridge_terms(entries: DataFrame, standard: DataFrame) -> DataFrame:
    """Entry names to dictionary codes: exact, else a blank-separated part, else the longest key contained in the name.

    Contained keys have two or more characters; they are looked for where their rarest gram is.
    """
    n = entries.select("entry_id", F.lower(F.trim("name")).alias("name"))
    exact = n.select("entry_id", F.col("name").alias("key"), F.lit(1).alias("tier"))
    parts = n.select("entry_id", F.explode(F.split("name", r"\s+")).alias("key"), F.lit(2).alias("tier"))
    keys = standard.where(F.length("key") >= 2).select(F.col("key").alias("needle"))
    held = contained(n.select(F.col("name").alias("text")), keys).select(F.col("text").alias("name"), F.col("needle").alias("key"))
    inner = n.join(held, "name").select("entry_id", "key", F.lit(3).alias("tier"))
    hits = exact.unionByName(parts).unionByName(inner).join(standard, "key")
    order = Window.partitionBy("entry_id").orderBy("tier", F.desc(F.length("key")), "key", "code10")
    best = hits.withColumn("r", F.row_number().over(order)).where("r = 1").select("entry_id", "key", "code10", "tier")
    return n.select("entry_id").join(best, "entry_id", "left").select("entry_id", "key", "code10", F.coalesce("tier", F.lit(0)).alias("tier"))


def merge_compositions(sheet: DataFrame, label: DataFrame) -> DataFrame:
    """Sheet entries (one a section and name), and label entries only for names that the sheet lacks."""
    one = sheet.groupBy("product", "section", "name").agg(F.min("pos").alias("pos"))
    rest = label.join(one.select("product", "name").distinct(), ["product", "name"], "left_anti")
    return one.withColumn("origin", F.lit("sheet")).unionByName(rest.select("product", "section", "name", "pos").withColumn("origin", F.lit("label")))


def detect_domain(lines: DataFrame, labels: DataFrame) -> DataFrame:
    """Domain of a page by how many of its words are labels of either domain; ambiguous on a tie, unknown without any."""
    w = lines.select("page_id", F.explode(F.split(F.lower("line"), "[^a-z]+")).alias("word")).join(labels, "word", "left")
    a, b = F.count_if(F.col("domain") == "a"), F.count_if(F.col("domain") == "b")
    return w.groupBy("page_id").agg(F.when((a == 0) & (b == 0), "unknown").when(a == b, "ambiguous").when(a > b, "a").otherwise("b").alias("domain"), a.alias("n_a"), b.alias("n_b"))


def scoped_vocabulary(owners: DataFrame, most: int = 3) -> DataFrame:
    """Words owned by at most `most` owners."""
    return owners.groupBy("word").agg(F.countDistinct("owner").alias("n_owners")).where(F.col("n_owners") <= most)


def gate_text(texts: DataFrame, vocabulary: DataFrame, most: int = 10) -> DataFrame:
    """Words of a text that the vocabulary holds (as written or in the singular), distinct, in first-seen order."""
    w = texts.select("doc_id", F.posexplode(F.split(F.lower("text"), r"[^a-z]+")).alias("pos", "word")).where("word <> ''")
    allowed = vocabulary.select("word").union(vocabulary.select(F.concat("word", F.lit("s")))).distinct()
    first = w.join(allowed, "word", "left_semi").groupBy("doc_id", "word").agg(F.min("pos").alias("pos"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("doc_id").orderBy("pos"))).where(F.col("r") <= most)
    kept = first.groupBy("doc_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("pos", "word"))), lambda x: x["word"]), " ").alias("kept"))
    return texts.select("doc_id").join(kept, "doc_id", "left").select("doc_id", F.coalesce("kept", F.lit("")).alias("kept"))


def harvest_phrases(rows: DataFrame, least: int = 4) -> DataFrame:
    """Distinct phrases of each owner, first seen first, of `least` characters or more."""
    p = rows.select("owner", "pos", F.posexplode(F.split("text", r"[.;\n]")).alias("part", "phrase")).withColumn("phrase", F.lower(F.trim("phrase")))
    first = p.where(F.length("phrase") >= least).groupBy("owner", "phrase").agg(F.min(F.struct("pos", "part")).alias("at"))
    return first.withColumn("place", F.row_number().over(Window.partitionBy("owner").orderBy("at", "phrase"))).drop("at")


def principal_candidates(entries: DataFrame) -> DataFrame:
    """Evidence for the principal ingredient: first listed 0.65, explicit percent 0.9 from 15 on, else 0.35; best confidence, bases joined."""
    first = entries.where("pos = 1").select("product", "name", F.lit(0.65).alias("c"), F.lit("first_listed").alias("basis"))
    share = entries.where("percent IS NOT NULL").select("product", "name", F.when(F.col("percent") >= 15, 0.9).otherwise(0.35).alias("c"), F.lit("percent").alias("basis"))
    g = first.unionByName(share).groupBy("product", "name").agg(F.max("c").alias("confidence"), F.array_join(F.sort_array(F.collect_set("basis")), ";").alias("bases"))
    return g.withColumn("confirmed", F.col("confidence") >= 0.8)


def scale_percent(entries: DataFrame) -> DataFrame:
    """Where the largest percent of a file is at most 1, its percents are fractions."""
    top = F.max("percent").over(Window.partitionBy("file"))
    return entries.withColumn("percent", F.when(top <= 1, F.col("percent") * 100).otherwise(F.col("percent")))


def latest_revision(files: DataFrame) -> DataFrame:
    """Newest file of each lineage: largest stamp, then name."""
    order = Window.partitionBy("lineage").orderBy(F.desc("stamp"), F.desc("name"))
    return files.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def drop_subsumed(forms: DataFrame) -> DataFrame:
    """Forms of a product whose set of names lies within another's go; of equal sets the first stays."""
    n = forms.select("product", "form", "name").distinct()
    size = n.groupBy("product", "form").agg(F.count(F.lit(1)).alias("n"))
    a, b = n.alias("a"), n.withColumnRenamed("form", "other").alias("b")
    shared = a.join(b, ["product", "name"]).where("form <> other").groupBy("product", "form", "other").agg(F.count(F.lit(1)).alias("s"))
    j = shared.join(size, ["product", "form"]).join(size.select("product", F.col("form").alias("other"), F.col("n").alias("m")), ["product", "other"])
    gone = j.where("s = n AND (n < m OR (n = m AND other < form))").select("product", "form").distinct()
    return size.join(gone, ["product", "form"], "left_anti")
