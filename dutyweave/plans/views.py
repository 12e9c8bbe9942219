"""Inputs that the registered queries derive from the given tables, in a wording both engines understand."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

GOODS = """
SELECT p_partkey, lower(p_name) AS label,
  lpad(CAST(p_partkey % 24 + 1 AS <S>), 2, '0') || lpad(CAST(p_size % 10 AS <S>), 2, '0') ||
  lpad(CAST((p_partkey <DIV> 24) % 5 * 10 AS <S>), 2, '0') || lpad(CAST((p_partkey <DIV> 120) % 4 * 10 AS <S>), 2, '0') ||
  lpad(CAST(p_partkey % 3 * 10 AS <S>), 2, '0') AS code10
FROM {part}
"""
MEASURES = """
SELECT l.l_orderkey * 10 + l.l_linenumber AS measure_id,
  CASE l.l_linenumber % 5 WHEN 0 THEN g.code10 WHEN 1 THEN substr(g.code10, 1, 8) || '00' WHEN 2 THEN substr(g.code10, 1, 6) || '0000'
    WHEN 3 THEN substr(g.code10, 1, 4) || '000000' ELSE substr(g.code10, 1, 2) || '00000000' END AS goods_code_10,
  CASE l.l_returnflag WHEN 'N' THEN '103' WHEN 'A' THEN '142' ELSE '143' END AS measure_type_code,
  l.l_linestatus = 'O' AS applies, 'R' || lpad(CAST(l.l_suppkey AS <S>), 4, '0') AS legal_base,
  CASE l.l_linenumber % 3 WHEN 0 THEN 'NIHIL'
    WHEN 1 THEN CAST(CAST(round(l.l_tax * 100) AS INT) AS <S>) || ' %'
    ELSE CAST(CAST(round(l.l_tax * 100) AS INT) AS <S>) || ' % + ' || CAST(CAST(l.l_quantity AS INT) AS <S>) || ' EUR/DTN' END AS duty_text
FROM {lineitem} l JOIN {goods} g ON g.p_partkey = l.l_partkey
"""


def for_duckdb(text: str) -> str:
    text = text.replace("<S>", "VARCHAR").replace("<DIV>", "//")
    for name in ("part", "lineitem", "goods"):
        text = text.replace("{" + name + "}", name)
    return text


def for_spark(text: str) -> str:
    return text.replace("<S>", "STRING").replace("<DIV>", "DIV")


WITH_GOODS = f"WITH goods AS ({for_duckdb(GOODS)})"
WITH_MEASURES = f"{WITH_GOODS}, measures AS ({for_duckdb(MEASURES)})"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def goods(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(for_spark(GOODS), part=table(spark, sf_dir, "part"))


def measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(for_spark(MEASURES), lineitem=table(spark, sf_dir, "lineitem"), goods=goods(spark, sf_dir))
