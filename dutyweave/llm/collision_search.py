"""Nearest neighbours by largest inner product through collision-counting hashing.

Inner products become distances by one extra coordinate: with M the largest norm of an
index block, a row x is completed by sqrt(M^2 - |x|^2), a query by 0, and distance
falls as the inner product rises. Each of PROJECTIONS random lines holds the rows of a
block as one sorted array. A query opens a window around its own value on every line
and widens all windows by virtual rehashing; a row inside the windows of enough lines
has collided often enough to be verified with its exact inner product. A query stops
when its windows are as wide as the distance of its k-th verified row, at which width
a closer row collides with probability 2 Phi(1) - 1 on each line.

Rows are dealt to cells around centres fitted on a bounded sample, large cells to
index blocks of bounded size. A query searches its own cell first. The score of its
k-th row there is carried on: a block whose centre and radius, or whose largest norm,
allow no better score is skipped without loss, and all others open their windows at
the carried width at once. So the work follows the blocks that can matter: few for
clustered vectors, all of them for vectors without any structure.

Components beyond 2^460 are scaled down by a power of two for the search; only the
reported score may then be infinite, ranks follow the scaled scores.

Defined results for odd input: a vector that is null, zero, or holds null or
non-finite components takes no part, nor does one whose length is not the commonest
one; a null vec_id takes no part; with fewer candidates than k all are returned;
equal scores go to the smaller vec_id; repeated ids are separate candidates, but
never of their own id; repeated rows of a query are searched once; an empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.llm.batches import per_batch
from dutyweave.staging import stage

PROJECTIONS = 64
#: Share of lines on which a row must collide: 2 Phi(1) - 1 less 2.1 standard deviations.
THRESHOLD = 0.56
WIDEN = 1.3
INDEX_ROWS = 16_384
QUERY_ROWS = 8192
#: Cells at most, and the bounded sample that their centres are fitted on.
CELLS = 1024
SAMPLE_ROWS = 16_384
#: Rows of a block whose positions on all lines are compared at a time.
TILE = 4096
#: Pairs of a query and a block that are written at a time.
VISITS = 1 << 20
FOUND = "query_id long, vec_id long, score double"


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v): rows that take part, as arrays of double."""
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).where("vec_id IS NOT NULL AND v IS NOT NULL")
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    return rows.where(F.size("v") == (width["d"] if width else 0))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Rows of equally long arrays as a matrix."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


class Block:
    """The sorted arrays of one index block, built once for all its queries."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, projections: int = PROJECTIONS) -> None:
        n, d = x.shape
        self.ids, self.x = ids, x
        sq = (x**2).sum(1)
        self.norm = math.sqrt(sq.max()) * (1 + 1e-9)
        self.lines = np.random.default_rng(20).normal(size=(d + 1, projections))
        on_line = (x @ self.lines[:d] + np.sqrt(np.maximum(self.norm**2 - sq, 0))[:, None] * self.lines[d]).T
        order = np.argsort(on_line, axis=1, kind="stable")
        self.values = np.take_along_axis(on_line, order, 1)
        place = np.empty(order.shape, np.uint16 if n <= 1 << 16 else np.uint32)
        np.put_along_axis(place, order, np.arange(n, dtype=place.dtype)[None], 1)
        self.tiles = [np.ascontiguousarray(place[:, a : a + TILE]) for a in range(0, n, TILE)]
        self.need = math.ceil(THRESHOLD * projections)

    def collided(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rows whose positions fall inside the windows [left, right) of enough lines."""
        kind = self.tiles[0].dtype
        full = right - left == len(self.ids)  # such a window's width may not fit the type
        low, width = left.astype(kind)[:, None], np.where(full, 0, right - left).astype(kind)[:, None]
        found = [np.add.reduce(((t - low) < width).view(np.uint8), 0, dtype=np.uint16) for t in self.tiles]
        return np.flatnonzero(np.concatenate(found) + int(full.sum()) >= self.need)

    def search(self, q_ids: np.ndarray, q: np.ndarray, k: int, carried: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Best k rows of the block for each query: arrays query_id, vec_id, score. carried: a score that k rows elsewhere reach, or -inf."""
        n, d = self.x.shape
        centre, q_sq = q @ self.lines[:d], (q**2).sum(1)

        def width(score: np.ndarray, j: np.ndarray) -> np.ndarray:
            return np.sqrt(np.maximum(self.norm**2 + q_sq[j] - 2 * score, 0)) * (1 + 1e-12)

        everyone = np.arange(len(q))
        known = np.isfinite(carried)
        half = np.where(known, width(np.where(known, carried, 0), everyone), 0.5 * self.norm)
        best = [(np.zeros(0, np.int64), np.zeros(0))] * len(q)
        seen: list[np.ndarray | None] = [None] * len(q)
        active = everyone
        while len(active):
            ends = [np.stack([np.searchsorted(v, centre[active, i] + sign * half[active], side) for i, v in enumerate(self.values)], 1) for sign, side in ((-1, "left"), (1, "right"))]
            again = []
            for j, left, right in zip(active.tolist(), *ends, strict=True):
                new = self.collided(left, right)
                if seen[j] is not None:
                    new = new[~seen[j][new]]
                else:
                    seen[j] = np.zeros(n, bool)
                seen[j][new] = True
                new = new[self.ids[new] != q_ids[j]]
                if len(new):
                    rows, scores = np.append(best[j][0], new), np.append(best[j][1], np.take(self.x, new, 0) @ q[j])
                    if len(rows) > k:  # whatever ties with the k-th stays for the sort
                        fine = scores >= np.partition(scores, len(scores) - k)[len(scores) - k]
                        rows, scores = rows[fine], scores[fine]
                    order = np.lexsort((self.ids[rows], -scores))[:k]
                    best[j] = rows[order], scores[order]
                least = max(carried[j], best[j][1][-1] if len(best[j][1]) == k else -np.inf)
                enough = width(np.array([least]), np.array([j]))[0] if np.isfinite(least) else np.inf
                if half[j] >= enough or (right - left == n).all():
                    seen[j] = None
                else:
                    half[j] = min(half[j] * WIDEN, enough)
                    again.append(j)
            active = np.array(again, np.int64)
        sizes = [len(r) for r, _ in best]
        return np.repeat(q_ids, sizes), self.ids[np.concatenate([r for r, _ in best])], np.concatenate([s for _, s in best])


def centres_of(x: np.ndarray, count: int, rounds: int = 8) -> np.ndarray:
    """count centres of the rows of x by Lloyd's rounds; a centre that loses all its rows stays where it was."""
    found = x[np.random.default_rng(3).permutation(len(x))[:count]].copy()
    for _ in range(rounds):
        near = np.argmax(x @ found.T - (found**2).sum(1) / 2, 1)
        total = np.zeros_like(found)
        np.add.at(total, near, x)
        held = np.bincount(near, minlength=len(found))
        found[held > 0] = total[held > 0] / held[held > 0, None]
    return found


def other_blocks(centre: np.ndarray, radius: np.ndarray, longest: np.ndarray, held: np.ndarray, parts: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Over queries (s, b, q, carried): every block but b that may hold a score of `carried` or more; VISITS pairs at most are looked at together."""
    at_once = max(1, VISITS // max(1, int(parts.sum())))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, at_once):
                batch = whole.slice(a, at_once)
                q, carried, home = matrix(batch.column("q")), batch.column("carried").to_numpy(zero_copy_only=False), batch.column("b").to_numpy()
                length = np.sqrt((q**2).sum(1))[:, None]
                most = np.minimum(q @ centre.T + length * radius, length * longest)
                may = np.repeat((most >= carried[:, None] - 1e-9 * length * longest) & (held > 0), parts, 1)
                may[np.arange(len(q)), home] = False
                row, b = np.nonzero(may)
                if len(row):
                    yield pa.record_batch([pa.array(b.astype(np.int32)), batch.column("s").take(pa.array(row)), pa.array(carried[row])], ["b", "s", "carried"])

    return run


def nearest(vectors: DataFrame, query_every: int = 20, k: int = 20, index_rows: int = INDEX_ROWS, query_rows: int = QUERY_ROWS, cells: int = CELLS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found for each row whose vec_id is divisible by query_every."""
    rows = stage(usable(vectors).withColumn("s", F.monotonically_increasing_id()), "vectors")
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.max(F.array_max(F.transform("v", F.abs))).alias("m")).first()
    scale = 2.0 ** max(0, math.ceil(math.log2(size["m"] or 1.0)) - 460)
    rows = rows.withColumn("v", F.transform("v", lambda x: x / scale)) if scale > 1 else rows
    u = F.pmod(F.xxhash64("s", F.lit(3)), F.lit(1_000_000_007)) / 1_000_000_007.0
    sample = rows.where(u < SAMPLE_ROWS / max(1, size["n"])).select("v").limit(2 * SAMPLE_ROWS).toArrow().column("v")
    count = max(1, min(cells, math.ceil(size["n"] / index_rows), len(sample)))
    centre = centres_of(matrix(sample), count) if len(sample) else np.zeros((1, 1))

    def to_cell(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = matrix(batch.column("v"))
        cell = np.argmax(x @ centre.T - (centre**2).sum(1) / 2, 1)
        apart = np.sqrt(((x - centre[cell]) ** 2).sum(1))
        return pa.record_batch([*batch.columns, pa.array(cell.astype(np.int32)), pa.array(apart), pa.array(np.sqrt((x**2).sum(1)))], [*batch.schema.names, "cell", "apart", "norm"])

    dealt = stage(rows.mapInArrow(per_batch(to_cell), "vec_id long, v array<double>, s long, cell int, apart double, norm double"), "cells")
    about = dealt.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.max("apart").alias("apart"), F.max("norm").alias("norm")).collect()  # one row a cell
    held, radius, longest = np.zeros(count, np.int64), np.zeros(count), np.zeros(count)
    for r in about:
        held[r["cell"]], radius[r["cell"]], longest[r["cell"]] = r["n"], r["apart"], r["norm"]
    parts = np.maximum(1, -(-held // index_rows))
    first = np.append(0, np.cumsum(parts))  # the first block of each cell
    of_cell = lambda a: F.element_at(F.array(*(F.lit(int(x)) for x in a)), F.col("cell") + 1)
    block = of_cell(first[:-1]) + F.pmod(F.xxhash64("s", F.lit(1)), of_cell(parts))
    index = dealt.select(block.cast("int").alias("b"), "vec_id", "v")
    asked = dealt.where(F.col("vec_id") % query_every == 0).groupBy("vec_id", "v").agg(F.min_by("cell", "s").alias("cell"), F.min("s").alias("s"))

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        b = Block(left.column("vec_id").to_numpy(), matrix(left.column("v")))
        a, i, s = b.search(right.column("query_id").to_numpy(), matrix(right.column("q")), k, right.column("carried").to_numpy())
        return pa.table({"query_id": a, "vec_id": i, "score": s})

    def search(visits: DataFrame) -> DataFrame:
        """visits (b, query_id, q, carried); a block with many queries is read by several tasks, each with some of them."""
        many = visits.groupBy("b").agg(F.ceil(F.count(F.lit(1)) / query_rows).cast("int").alias("copies"))
        visits = visits.join(many, "b").withColumn("c", F.pmod(F.xxhash64("query_id", F.lit(2)), F.col("copies")).cast("int"))
        copied = index.join(many, "b").withColumn("c", F.explode(F.sequence(F.lit(0), F.col("copies") - 1)))
        return copied.select("b", "c", "vec_id", "v").groupBy("b", "c").cogroup(visits.select("b", "c", "query_id", "q", "carried").groupBy("b", "c")).applyInArrow(meet, FOUND)

    at_home = asked.select("s", block.cast("int").alias("b"), F.col("vec_id").alias("query_id"), F.col("v").alias("q"), F.lit(float("-inf")).alias("carried"))
    home = stage(search(at_home), "found-at-home")
    kth = home.groupBy("query_id").agg(F.min("score").alias("least"), F.count(F.lit(1)).alias("found"))
    kth = kth.select("query_id", F.when(F.col("found") == k, F.col("least")).alias("least"))
    carried = at_home.drop("carried").join(kth, "query_id", "left").select("s", "b", "q", F.coalesce("least", F.lit(float("-inf"))).alias("carried"))
    visits = stage(carried.mapInArrow(other_blocks(centre, radius, longest, held, parts), "b int, s long, carried double"), "visits")
    elsewhere = search(visits.join(at_home.select("s", "query_id", "q"), "s"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = home.unionByName(elsewhere).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", (F.col("score") * scale * scale).alias("score"))


def op3_collision_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
