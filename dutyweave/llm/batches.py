"""Helpers for operators whose work inside tasks is Arrow batches and numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Rows of an Arrow batch sent to Python; texts can be long.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Asks the session for Arrow batches of at most so many rows, unless it is set lower."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key, "10000")) <= rows:
        spark.conf.set(key, str(rows))


def held_out(doc_id: Column) -> Column:
    """crc32(doc_id as text) mod 3 = 1; a null doc_id is not held out."""
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def may_learn(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 != 1, F.lit(False))


def per_batch(fn: Callable[[pa.RecordBatch], pa.RecordBatch | None]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out

    return run


def seeded_sample(rows: DataFrame, key: Column, stratum: Column, per_stratum: int, seed: int, most_rows: int = 100_000, max_strata: int = 4096) -> DataFrame:
    """About per_stratum rows of each stratum, chosen by a hash of key; for use on the driver.

    Bounds: with many strata each gets fewer rows, so that all have about most_rows; beyond max_strata the smallest are left out.
    """
    s = rows.withColumn("_stratum", stratum.cast("string")).where(F.col("_stratum").isNotNull())
    counts = s.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_rows")).orderBy(F.desc("_rows"), "_stratum").limit(max_strata)
    each = F.least(F.lit(per_stratum), F.greatest(F.lit(1), F.floor(F.lit(most_rows) / F.count(F.lit(1)).over(Window.partitionBy()))))
    u = F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1_000_000_007)) / 1_000_000_007.0
    rated = counts.select("_stratum", (each / F.col("_rows")).alias("_rate"))  # at most max_strata rows
    most = rated.agg(F.max("_rate")).first()[0]  # this bound reaches the scan, before rows meet anything
    return s.where(u < (most or 0.0)).withColumn("_u", u).join(F.broadcast(rated), "_stratum").where("_u < _rate").select(*rows.columns)
