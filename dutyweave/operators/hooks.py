"""Hooks for models that the caller supplies."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Vectors of a block, queries that meet it at once, and scores that are held at a time.
BLOCK_ROWS = 32_768
QUERY_ROWS = 8192
TILE = 1 << 21


def embed(texts: DataFrame, fn: Callable[[list[str]], list[list[float]]]) -> DataFrame:
    """(id, vector) of rows (id, text) by the caller's batch function."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "vector": list(fn(f["text"].fillna("").tolist()))})

    return texts.select("id", "text").mapInPandas(run, "id long, vector array<float>")


def ask(rows: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """(id, answer) of rows (id, prompt) by the caller's batch function."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame({"id": f["id"], "answer": fn(f["prompt"].fillna("").tolist())})

    return rows.select("id", "prompt").mapInPandas(run, "id long, answer string")


def translate_missing(names: DataFrame, cache: DataFrame, fn: Callable[[list[str]], list[str]]) -> DataFrame:
    """The cache with translations of names it lacks; cached names are never overwritten."""
    new = names.select("name").distinct().where(F.col("name").rlike(r"[^\x00-\x7F]")).join(cache, "name", "left_anti")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for i in range(0, len(f), 120):
                part = f["name"].iloc[i : i + 120].tolist()
                yield pd.DataFrame({"name": part, "translation": fn(part)})

    return cache.select("name", "translation").unionByName(new.mapInPandas(run, "name string, translation string"))


def _best_of_block(vectors: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """(query_id, vec_id, score) of the k best vectors of a block for each query, by score to six places, then vec_id."""
    found: dict[str, list] = {"query_id": [], "vec_id": [], "score": []}
    vectors = vectors.sort_by("vec_id")
    (v, v_width), (q, q_width) = _unit_rows(vectors.column("v")), _unit_rows(queries.column("q"))
    ids, asked = vectors.column("vec_id").to_numpy(), queries.column("query_id").to_numpy()
    block = {w: (to := np.flatnonzero(v_width == w), np.array([v[i] for i in to], np.float64).reshape(len(to), w)) for w in set(v_width.tolist()) - {-1}}
    for a in range(0, len(asked) if len(ids) else 0, step := max(1, TILE // max(1, len(ids)))):
        own, score = asked[a : a + step], np.full((len(asked[a : a + step]), len(ids)), np.nan)
        none = np.ones(score.shape, bool)  # unlike widths and missing numbers have no score
        for width, (to, right) in block.items():
            at = np.flatnonzero(q_width[a : a + step] == width)
            score[np.ix_(at, to)] = np.array([q[i] for i in at + a], np.float64).reshape(len(at), width) @ right.T
            none[np.ix_(at, to)] = False
        key = np.floor(np.abs(score) * 1e6 + 0.5) * np.sign(score)
        key = np.where(none, np.finfo(float).min, np.where(np.isnan(key), np.inf, key))
        key[own[:, None] == ids[None, :]] = -np.inf
        few = min(k, len(ids))
        row, col = np.nonzero((key >= np.partition(key, len(ids) - few, 1)[:, len(ids) - few][:, None]) & (key > -np.inf))
        order = np.lexsort((col, -key[row, col], row))
        row, col = row[order], col[order]
        first = np.arange(len(row)) - np.searchsorted(row, row) < k
        row, col = row[first], col[first]
        found["query_id"].append(own[row])
        found["vec_id"].append(ids[col])
        found["score"].append(pa.array(score[row, col], mask=none[row, col], from_pandas=False))
    flat = {c: np.concatenate(found[c]) if found[c] else np.zeros(0, np.int64) for c in ("query_id", "vec_id")}
    return pa.table({**flat, "score": pa.chunked_array(found["score"], pa.float64())})


def _unit_rows(column: pa.ChunkedArray) -> tuple[list[np.ndarray | None], np.ndarray]:
    """Rows of length one in double precision, and their widths; -1 for a row that is missing or lacks a number. A zero row has no direction: NaN."""
    rows: list[np.ndarray | None] = []
    for item in column:
        values = item.values
        row = None if values is None or values.null_count else values.to_numpy(zero_copy_only=False).astype(np.float64)
        with np.errstate(divide="ignore", invalid="ignore"):
            rows.append(None if row is None else row / np.sqrt((row * row).sum()))
    return rows, np.array([-1 if r is None else len(r) for r in rows], np.int64)


def cosine_top_k(queries: DataFrame, vectors: DataFrame, k: int = 5) -> DataFrame:
    """k nearest vectors of the same label by cosine similarity, each query against every vector of its label.

    The work is queries times vectors of a label, as products of blocks of both; a block keeps k rows for each query. Vectors
    without a score (null, or of another width) come last, those against a zero vector score NaN.
    """
    fine = lambda t: t.where("vec_id IS NOT NULL AND label IS NOT NULL")
    q = fine(queries).select(F.col("vec_id").cast("long").alias("query_id"), "label", F.col("embedding").alias("q"))
    v = fine(vectors).select(F.col("vec_id").cast("long").alias("vec_id"), "label", F.col("embedding").alias("v"))
    blocks, groups = (max(1, math.ceil(t.count() / n)) for t, n in ((v, BLOCK_ROWS), (q, QUERY_ROWS)))
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    dealt = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    v = v.withColumn("b", dealt("vec_id", blocks)).withColumn("g", spread(groups))
    q = q.withColumn("g", dealt("query_id", groups)).withColumn("b", spread(blocks))
    by = ["label", "b", "g"]
    s = v.groupBy(*by).cogroup(q.groupBy(*by)).applyInArrow(lambda left, right: _best_of_block(left, right, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return s.withColumn("score", F.round("score", 6)).withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
