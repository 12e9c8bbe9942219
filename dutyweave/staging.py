"""Written intermediate tables.

A job that reads the same intermediate rows twice writes them once, as Parquet,
into the shared folder of the cluster. A lost executor then costs a re-read, not
a recomputation, and the lineage of iterative jobs stays short.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_CONF = "spark.checkpoint.dir"


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; where that is unset, a folder of our own in local mode only: executors of a cluster would not share it."""
    found = spark.conf.get(_CONF, None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError(f"{_CONF} must name a folder that driver and executors share")
        found = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set(_CONF, found)
    return found.rstrip("/")


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df once under the shared folder and return a reader of the written table."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/stage/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    written = spark.read.schema(df.schema).parquet(path)
    written.staged_at = path
    return written


def meet(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """A join by sorting and merging, for rows that grow with the input: written or shuffled, repeated texts are a small part of
    their size in memory, so Spark would take them for small ones and pass them through the driver."""
    return left.join(right.hint("merge"), on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Rows shuffled by keys into all shuffle partitions, none merged: Spark merges them by their size when written, and repeated
    texts take many times that in memory when they are sorted."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def discard(written: DataFrame) -> None:
    """Deletes what stage wrote, once nothing reads it any more."""
    jvm = written.sparkSession._jvm
    at = jvm.org.apache.hadoop.fs.Path(written.staged_at)
    at.getFileSystem(written.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(at, True)
