"""URL rules by a Bloom filter cascade (DataFrame functions only).

Rules name a host and a path; a rule fits its host and all subdomains when the
url's path starts with the rule's path, and the longest fitting rule decides. Every
url is turned into the few keys (host suffix + path prefix) that could be rules.
Level 1 of a cascade encodes the listed keys; level 2 encodes the keys of the
corpus that pass level 1 without being listed; level 3 the listed keys that pass
level 2, and so on until no false positive is left. Since the levels are built
against the complete key universe of the corpus, membership is exact, and pages are
judged by testing bits, without a join.

The filters' size follows the number of listed keys and the logarithm of the
universe. It is checked: above MAX_BITS the keys are joined with the list instead.

Defined results for odd input: a null url, or one without "://", has empty host and
path and fits no rule; where no rule fits the verdict is allow; a key that is listed
with both verdicts is blocked; repeated rows are judged alike; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
import string
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyweave.staging import stage

#: Rules of the registered query: host, path, verdict.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
MAX_BITS = 1 << 26


def url_host(url: Column) -> Column:
    host = F.coalesce(F.regexp_extract(url, r"://([^/?#]*)", 1), F.lit(""))
    return F.translate(host, string.ascii_uppercase, string.ascii_lowercase)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"://[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_keys(host: Column, path: Column, labels: list[int], lengths: list[int]) -> Column:
    """Distinct keys that could be rules, longest first: suffixes of `labels` labels with path prefixes of `lengths` characters."""
    found = [
        F.when(F.length(path) >= n, F.concat(F.substring_index(host, ".", -k), F.substring(path, 1, n))) for k in sorted(labels) for n in sorted(lengths)
    ]
    keys = F.array_distinct(F.array_compact(F.array(*found)))
    ordered = F.sort_array(F.transform(keys, lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))), asc=False)
    return F.transform(ordered, lambda x: x["key"])


@dataclass(frozen=True)
class Level:
    bits: bytes
    m: int
    hashes: int
    salt: int

    def positions(self, key: Column) -> list[Column]:
        return [F.pmod(F.xxhash64(F.lit(self.salt * 64 + i), key), F.lit(self.m)) for i in range(self.hashes)]

    def contains(self, key: Column) -> Column:
        table, hit = F.lit(bytearray(self.bits)), F.lit(True)
        for p in self.positions(key):
            byte = F.conv(F.hex(F.substring(table, (F.floor(p / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
            hit = hit & (F.getbit(byte, (p % 8).cast("int")) == 1)
        return hit


def _encode(keys: DataFrame, n: int, rate: float, salt: int) -> Level:
    """A Bloom filter of n keys with the given false-positive rate; its bits are or-ed together on the executors."""
    m = max(64, math.ceil(n * 1.4427 * math.log2(1 / rate)))
    empty = Level(b"", m, max(1, round(math.log2(1 / rate))), salt)
    at = keys.select(F.explode(F.array(*empty.positions(F.col("key")))).alias("p"))
    words = at.groupBy(F.floor(F.col("p") / 32).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(p % 32 AS INT))")).alias("b"))
    bits = bytearray(4 * (m // 32 + 1))
    for row in words.collect():  # at most m / 32 rows, of a checked m
        bits[4 * row.w : 4 * row.w + 4] = row.b.to_bytes(4, "little")
    return Level(bytes(bits), m, empty.hashes, salt)


def build_cascade(listed: DataFrame, universe: DataFrame, max_bits: int = MAX_BITS) -> list[Level] | None:
    """Levels over (key) tables, exact on listed and universe together; None where the filters would exceed max_bits."""
    inside, outside = listed.select("key").distinct(), universe.select("key").join(listed.select("key"), "key", "left_anti").distinct()
    n, s, levels = inside.count(), outside.count(), []
    if n == 0:
        return []
    rate = min(0.5, math.sqrt(0.5) * n / max(s, 1))
    while n:
        if n * 1.4427 * math.log2(1 / rate) > max_bits:
            return None
        levels.append(_encode(inside, n, rate, len(levels)))
        false_hits = stage(outside.where(levels[-1].contains(F.col("key"))), f"cascade-{len(levels)}")
        inside, outside, n, rate = false_hits, inside, false_hits.count(), 0.5
    return levels


def cascade_contains(levels: list[Level], key: Column) -> Column:
    """True if key, of the lists the cascade was built on, is listed: the first level that lacks it decides."""
    answer = F.lit(len(levels) % 2 == 1)
    for i in range(len(levels) - 1, -1, -1):
        answer = F.when(levels[i].contains(key), answer).otherwise(F.lit(i % 2 == 1))
    return answer


def judge_urls(pages: DataFrame, rules: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """(page_id, host, path, rule, verdict) of pages with (page_id, url); rules: (host, path, verdict)."""
    rules = rules.select("host", "path", "verdict", F.concat("host", "path").alias("key"))
    shape = rules.agg(F.collect_set(F.size(F.split("host", r"\."))).alias("k"), F.collect_set(F.length("path")).alias("n")).first()
    urls = pages.select("page_id", F.col("url").cast("string").alias("_url"))
    urls = urls.select("page_id", url_host(F.col("_url")).alias("host"), url_path(F.col("_url")).alias("path"))
    if not shape.k:
        return urls.select("*", F.lit(None).cast("string").alias("rule"), F.lit("allow").alias("verdict"))
    urls = urls.withColumn("_keys", rule_keys(F.col("host"), F.col("path"), shape.k, shape.n))
    universe = stage(urls.select(F.explode("_keys").alias("key")).distinct(), "url-keys")
    blocked = rules.where("verdict = 'block'").select("key")
    levels = build_cascade(rules.select("key"), universe, max_bits)
    blocks = build_cascade(blocked, rules.select("key"), max_bits)
    if levels is None or blocks is None:
        return _judge_by_join(urls, rules)
    urls = urls.withColumn("rule", F.get(F.filter("_keys", lambda k: cascade_contains(levels, k)), F.lit(0)))
    return urls.select(
        "page_id", "host", "path", "rule", F.when(F.col("rule").isNotNull() & cascade_contains(blocks, F.col("rule")), "block").otherwise("allow").alias("verdict")
    )


def _judge_by_join(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """The way beyond MAX_BITS: distinct keys of the corpus meet the list in a shuffle, then go back to their urls."""
    known = rules.groupBy("key").agg(F.max(F.col("verdict") == "block").alias("_block"))
    hits = urls.select("host", "path", F.explode("_keys").alias("key")).distinct().join(known, "key")
    best = hits.groupBy("host", "path").agg(F.max(F.struct(F.length("key").alias("n"), "key", "_block")).alias("_best"))
    joined = urls.join(best, ["host", "path"], "left")
    return joined.select("page_id", "host", "path", F.col("_best.key").alias("rule"), F.when(F.col("_best._block"), "block").otherwise("allow").alias("verdict"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.sql("SELECT * FROM VALUES " + ", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES) + " AS t(host, path, verdict)")
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"), rules)


ORACLE = r"""
WITH u AS (
  SELECT page_id,
         translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages),
r(rhost, rpath, v) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
m AS (
  SELECT page_id, host, path, rhost || rpath AS rule, v,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC) AS k
  FROM u JOIN r ON (host = rhost OR suffix(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT u.page_id, u.host, u.path, m.rule, coalesce(m.v, 'allow') AS verdict
FROM u LEFT JOIN m ON m.page_id = u.page_id AND m.k = 1
"""
