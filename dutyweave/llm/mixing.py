"""Mixing sources to target weights by Sainte-Lague apportionment (DataFrame functions only).

The mix is dealt in equal-token blocks. Blocks go to sources by the highest
quotients target / (2k + 1), then, within a source, to its shards by the same rule
over shard sizes, which gives every shard an integer quota. A shard lays its
documents out in a seeded order and takes its quota of blocks from the start,
going round a second time where the quota exceeds the shard.

Highest quotients never need a full quotient list: with n parties and S seats the
seats of a party lie between those of the divisors V/(S - n/2) and V/(S + n/2), so
about two open quotients a party decide the rest.

Defined results for odd input: a null or empty text has size 0 and is never taken;
a null source is a source of its own, last in order; a null doc_id is an ordinary
key; repeated rows are dealt separately; an empty table gives an empty result;
columns of the input that are not used pass through mix_documents unchanged.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.staging import stage

WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
MAX_REPEAT = 2.0
BLOCK_WORDS = 16
SHARD_WORDS = 1 << 18
WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def seeded(doc_id: Column, seed: int) -> Column:
    """A non-negative 60-bit number from a row's key."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, max_repeat: float = MAX_REPEAT) -> DataFrame:
    """(rank, source, source_size, target) of a table with (source, size).

    Weighted shares are capped at max_repeat times a source's size. Sharing the
    excess again by weight until none is above ends at one level: sources whose
    cap per weight is lowest are full, all others get weight times one factor.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    grouped = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = grouped.withColumn("rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    ranked = ranked.withColumn("w", F.element_at(cycle, (F.pmod(F.col("rank") - 1, F.lit(len(weights))) + 1).cast("int")))
    ranked = ranked.withColumn("cap", F.lit(max_repeat) * F.col("source_size"))
    every = Window.partitionBy()
    fill = Window.orderBy(F.col("cap") / F.col("w"), "rank")
    before = fill.rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumn("want", F.lit(share) * F.sum("source_size").over(every))
    ranked = ranked.withColumn(
        "level",
        (F.col("want") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / (F.sum("w").over(every) - F.coalesce(F.sum("w").over(before), F.lit(0.0))),
    )
    open_level = F.min(F.when(F.col("cap") / F.col("w") > F.col("level"), F.struct((F.col("cap") / F.col("w")).alias("r"), "rank", "level"))).over(every)
    ranked = ranked.withColumn("factor", open_level["level"])
    return ranked.select(
        "rank", "source", "source_size", F.coalesce(F.least(F.col("cap"), F.col("w") * F.col("factor")), F.col("cap")).alias("target")
    )


def apportion(parties: DataFrame, group: list[str], party: str, votes: str, seats: str) -> DataFrame:
    """Adds long column `quota`: Sainte-Lague seats of each party of a group; ties to the smaller party."""
    of_group = Window.partitionBy(*group) if group else Window.partitionBy()
    v, s = F.col(votes).cast("double"), F.col(seats).cast("double")
    t = parties.withColumn("_n", F.count(F.lit(1)).over(of_group).cast("double")).withColumn("_v", F.sum(v).over(of_group))
    share = F.when(F.col("_v") > 0, v / F.col("_v")).otherwise(F.lit(0.0))
    t = t.withColumn("_lo", F.greatest(F.lit(0), F.floor(share * F.greatest(s - F.col("_n") / 2, F.lit(0.0)) + 0.5) - 1).cast("long"))
    t = t.withColumn("_hi", F.when(v > 0, F.floor(share * (s + F.col("_n") / 2) + 0.5) + 1).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("_left", s - F.sum("_lo").over(of_group))
    open_seats = t.where("_hi > _lo").select(*group, party, "_left", v.alias("_votes"), F.explode(F.sequence("_lo", F.col("_hi") - 1)).alias("_k"))
    order = Window.partitionBy(*group) if group else Window.partitionBy()
    order = order.orderBy((F.col("_votes") / (2 * F.col("_k") + 1)).desc(), party)
    won = open_seats.withColumn("_r", F.row_number().over(order)).where("_r <= _left").groupBy(*group, party).agg(F.count(F.lit(1)).alias("_won"))
    return (
        t.join(won, [*group, party], "left")
        .withColumn("quota", F.col("_lo") + F.coalesce(F.col("_won"), F.lit(0)))
        .drop("_n", "_v", "_lo", "_hi", "_left", "_won")
    )


def mix_rows(rows: DataFrame, seed: int = 1, block_words: int = BLOCK_WORDS, shard_words: int = SHARD_WORDS, plan_from: DataFrame | None = None) -> DataFrame:
    """Adds source_size, target and taken to rows with (doc_id, source, size); other columns pass through.

    plan_from: the same rows without their other columns, already written, from which quotas are computed.
    """
    sizes = plan_from if plan_from is not None else rows.select("doc_id", "source", "size")
    targets = source_targets(sizes).withColumn("_blocks", F.round(F.lit(SHARE) * F.sum("source_size").over(Window.partitionBy()) / block_words).cast("long"))
    sources = apportion(targets, [], "rank", "target", "_blocks").select(
        F.col("rank").alias("_rank"),
        F.col("source").alias("_source"),
        "source_size",
        "target",
        F.col("quota").alias("_seats"),
        F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long").alias("_shards"),
    )
    sources = stage(sources, "mix-sources")

    def sharded(t: DataFrame) -> DataFrame:
        t = t.join(sources, t["source"].eqNullSafe(sources["_source"])).drop("_source")
        return t.withColumn("_h", seeded(F.col("doc_id"), seed)).withColumn("_shard", F.pmod(F.col("_h"), F.col("_shards")))

    shards = sharded(sizes).groupBy("_rank", "_shard").agg(F.sum("size").alias("_z"), F.first("_seats").alias("_seats"))
    quotas = apportion(shards, ["_rank"], "_shard", "_z", "_seats").select("_rank", "_shard", "_z", "quota")
    quotas = stage(quotas, "mix-shards")
    t = sharded(rows).join(quotas, ["_rank", "_shard"])
    line = Window.partitionBy("_rank", "_shard").orderBy("_h", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_c", F.coalesce(F.sum("size").over(line), F.lit(0)))
    words = F.least(F.col("quota") * block_words, 2 * F.col("_z"))
    t = t.withColumn("_full", F.when(F.col("_z") > 0, F.floor(words / F.col("_z"))).otherwise(F.lit(0)).cast("long"))
    t = t.withColumn("_part", F.greatest(F.lit(0), F.least(F.col("size"), words - F.col("_full") * F.col("_z") - F.col("_c"))).cast("long"))
    t = t.withColumn("taken", F.col("_full") * F.col("size") + F.col("_part"))
    return t.drop("_rank", "_shard", "_seats", "_shards", "_h", "_z", "quota", "_c")


def document_sizes(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"))


def mix_documents(docs: DataFrame, seed: int = 1) -> DataFrame:
    """The mixed corpus with the columns of docs: a row for each whole copy taken, and one cut after the words of a last, partial take."""
    cols = docs.columns
    sizes = stage(document_sizes(docs), "mix-sizes")
    packed = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), F.struct(*cols).alias("_row")
    )
    t = mix_rows(packed, seed, plan_from=sizes).where("taken > 0")
    text = F.col("_row.text").cast("string")
    pieces = F.split(text, r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_part").cast("int")), "")
    texts = F.concat(
        F.array_repeat(text, F.col("_full").cast("int")),
        F.when(F.col("_part") >= F.col("size"), F.array(text)).when(F.col("_part") > 0, F.array(cut)).otherwise(F.array().cast("array<string>")),
    )
    t = t.select("_row", F.explode(texts).alias("_text"))
    return t.select(*[F.col("_text").alias(c) if c == "text" else F.col("_row")[c].alias(c) for c in cols])


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = stage(document_sizes(spark.read.parquet(f"{sf_dir}/documents.parquet")), "mix-sizes")
    return mix_rows(sizes, plan_from=sizes).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         CAST('0x' || substr(md5('1:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 15) AS BIGINT) AS h
  FROM documents),
g AS (SELECT source, sum(size) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS rk FROM g),
c AS (SELECT *, [5.0, 2.0, 1.0][(rk - 1) % 3 + 1]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS want FROM r),
f AS (SELECT *, (want - coalesce(sum(cap) OVER b, 0)) / (sum(w) OVER () - coalesce(sum(w) OVER b, 0)) AS lv FROM c
      WINDOW b AS (ORDER BY cap / w, rk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (SELECT *, coalesce(least(cap, w * (SELECT lv FROM f WHERE cap / w > lv ORDER BY cap / w, rk LIMIT 1)), cap) AS target,
             greatest(1, ceil(source_size / 262144))::BIGINT AS shards FROM f),
q AS (SELECT rk, target / (2 * k + 1) AS v FROM t, unnest(range(0, CAST(target / 16 * 2 AS BIGINT) + 50)) AS u(k) WHERE target > 0),
won AS (SELECT rk, count(*) AS seats FROM (SELECT rk, row_number() OVER (ORDER BY v DESC, rk) AS i FROM q) WHERE i <= (SELECT CAST(round(max(want) / 16) AS BIGINT) FROM t) GROUP BY rk),
e AS (SELECT d.*, t.rk, t.source_size, t.target, h % shards AS shard, coalesce(seats, 0) AS seats FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source LEFT JOIN won USING (rk)),
z AS (SELECT rk, shard, sum(size) AS z, max(seats) AS seats FROM e GROUP BY ALL),
zq AS (SELECT rk, shard, seats, z / (2 * k + 1) AS v FROM z, unnest(range(0, CAST(z / 16 * 4 AS BIGINT) + 50)) AS u(k) WHERE z > 0),
zw AS (SELECT rk, shard, count(*) AS quota FROM (SELECT *, row_number() OVER (PARTITION BY rk ORDER BY v DESC, shard) AS i FROM zq) WHERE i <= seats GROUP BY ALL),
x AS (SELECT e.*, z.z, least(coalesce(quota, 0) * 16, 2 * z.z) AS words,
             coalesce(sum(size) OVER (PARTITION BY e.rk, e.shard ORDER BY h, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c
      FROM e JOIN z USING (rk, shard) LEFT JOIN zw USING (rk, shard))
SELECT doc_id, size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(CASE WHEN z > 0 THEN words // z * size + greatest(0, least(size, words - words // z * z - c)) ELSE 0 END AS BIGINT) AS taken
FROM x
"""
