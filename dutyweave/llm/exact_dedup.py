"""Exact duplicates by a heavy-hitter split (DataFrame functions only).

Texts are equal when they are identical after deleting every character of
``[\\x20\\x09-\\x0D]``. A Misra-Gries style frequent-items sketch names digests that
may be frequent; their groups are counted exactly and the verified ones, whose
number is bounded by the sketch, are broadcast, so that rows of hot groups are
resolved where they are read. All other digests go through an ordinary shuffle,
where no group can be larger than the sketch's error bound.

Defined results for odd input: a null text counts as empty; a null doc_id loses
every tie; rows that repeat doc_id and text are counted in group_size and all
carry the same flag; an empty table gives an empty result; other columns of the
input are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.staging import stage

#: Counters of the sketch: a digest held by more than about 3.5 / MAX_TRACKED of all rows is always found.
MAX_TRACKED = 8192
#: Rows of the broadcast side; the sketch cannot name more.
TOP_K = 2048
#: First-level sketches, merged once; keeps the merge small at any number of input splits.
SKETCH_GROUPS = 64


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")


def digests(docs: DataFrame, *others: str) -> DataFrame:
    """(doc_id, n, sha) and other columns: code points of the original text, SHA-256 of the normalised text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.length(text).alias("n"),
        F.unhex(F.sha2(F.encode(normalised(F.col("text").cast("string")), "UTF-8"), 256)).alias("sha"),
        *others,
    )


def short_key(sha: Column) -> Column:
    """Eight bytes of the digest, as the sketch tracks them."""
    return F.conv(F.hex(F.substring(sha, 1, 7)), 16, 10).cast("long")


def _winner(n: Column, doc_id: Column) -> Column:
    """Most code points, then smallest doc_id; nulls lose."""
    return F.max(F.struct(n.alias("n"), (-doc_id).alias("neg")))


def heavy_groups(rows: DataFrame, max_tracked: int = MAX_TRACKED, top_k: int = TOP_K) -> DataFrame:
    """Exact groups of the digests that the frequent-items sketch names; at most top_k keys."""
    keyed = rows.select(short_key(F.col("sha")).alias("k"))
    sketches = keyed.groupBy(F.pmod(F.spark_partition_id(), F.lit(SKETCH_GROUPS)).alias("g")).agg(
        F.expr(f"approx_top_k_accumulate(k, {max_tracked})").alias("s")
    )
    # grouped by a constant: an ungrouped aggregate would merge the untyped sketches of empty partitions
    named = sketches.groupBy(F.lit("all").alias("g")).agg(F.expr(f"approx_top_k_combine(s, {max_tracked})").alias("s")).select(
        F.explode(F.expr(f"approx_top_k_estimate(s, {top_k})")).alias("e")
    )
    named = named.where("e.count > 1").select(F.col("e.item").alias("k"))
    found = (
        rows.withColumn("k", short_key(F.col("sha")))
        .join(F.broadcast(named), "k", "left_semi")
        .groupBy("sha")
        .agg(F.count(F.lit(1)).alias("group_size"), _winner(F.col("n"), F.col("doc_id")).alias("w"))
    )
    return found.where("group_size > 1").orderBy(F.desc("group_size"), "sha").limit(top_k)


def exact_duplicates(docs: DataFrame, max_tracked: int = MAX_TRACKED, top_k: int = TOP_K) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    rows = stage(digests(docs), "exact-digests")
    heavy = stage(heavy_groups(rows, max_tracked, top_k), "exact-heavy")
    tagged = rows.join(F.broadcast(heavy), "sha", "left")
    hot = tagged.where(F.col("w").isNotNull())
    by_digest = Window.partitionBy("sha")
    cold = tagged.where(F.col("w").isNull()).select(
        "sha",
        "doc_id",
        "n",
        F.count(F.lit(1)).over(by_digest).alias("group_size"),
        _winner(F.col("n"), F.col("doc_id")).over(by_digest).alias("w"),
    )
    return hot.select(*cold.columns).unionByName(cold).select(
        "doc_id",
        (-F.col("w.neg")).alias("keep_id"),
        F.col("group_size").cast("long").alias("group_size"),
        (F.col("doc_id").eqNullSafe(-F.col("w.neg")) & (F.col("n") == F.col("w.n"))).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )


def drop_duplicates(docs: DataFrame, max_tracked: int = MAX_TRACKED, top_k: int = TOP_K) -> DataFrame:
    """One row of docs for each distinct text, with all its columns; of rows that share text and doc_id any one.

    Rows of hot groups meet their winner by broadcast and are combined where they are read; the rest meet theirs in one
    shuffle by text and doc_id, in which a row number leaves one of repeated rows.
    """
    rows = stage(digests(docs), "exact-digests")
    heavy = stage(heavy_groups(rows, max_tracked, top_k), "exact-heavy")
    id_of = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    cold = rows.join(F.broadcast(heavy.select("sha")), "sha", "left_anti").groupBy("sha").agg(_winner(F.col("n"), F.col("doc_id")).alias("w"))
    winners = cold.select("sha", F.col("w.n").alias("n"), F.coalesce((-F.col("w.neg")).cast("string"), F.lit("")).alias("id"))
    keys = digests(docs.select("doc_id", "text", F.struct(*docs.columns).alias("row")), "row").withColumn("id", id_of)
    hot = keys.join(F.broadcast(heavy.select("sha", F.col("w.n").alias("wn"), F.coalesce((-F.col("w.neg")).cast("string"), F.lit("")).alias("wid"))), "sha")
    hot = hot.where("n = wn AND id = wid").groupBy("sha").agg(F.first("row").alias("row")).select("row")
    met = keys.join(winners.hint("shuffle_merge"), ["sha", "n", "id"])
    met = met.withColumn("k", F.row_number().over(Window.partitionBy("sha", "n", "id").orderBy(F.lit(0)))).where("k = 1")
    return met.select("row").unionByName(hot).select(*[F.col("row")[c].alias(c) for c in docs.columns])


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS sha
  FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY sha) AS group_size,
       doc_id = first_value(doc_id) OVER w AS kept,
       sha AS text_sha256
FROM d WINDOW w AS (PARTITION BY sha ORDER BY n DESC, doc_id)
"""
