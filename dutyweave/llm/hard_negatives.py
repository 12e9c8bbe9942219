"""Hard negatives by exact integer scores from Kronecker-packed products.

Components become integers, floor(256 * x). A block of candidates is packed: components are
biased to be non-negative, and several candidates' components of one dimension lie in
separated fields of one wide integer. An anchor component, biased too, is multiplied with
it once for all of them; as no field's sum can reach the next field, the sums over the
dimensions unpack to the exact scores. Where two fields or more fit into the 53 bits that
a double holds exactly, the wide integers are doubles and the sums a matrix product; where
components are larger, they are Python's integers, with fields as wide as need be.

Rows are dealt to blocks by hash. A first pass finds each anchor's positives: the best of
each block, then the best of these. A second pass takes the positives' scores along and
finds, in each block, the best rows of another label inside every positive's range. A block
sends at most `positives` (or positives x negatives) rows for each anchor.

Defined results for odd input: rows with a null label, a null or empty vector, or a null or
non-finite component take no part, nor do rows with a null vec_id or a length that is not
the commonest one; repeated rows are candidates of their own, but never of their own id,
and repeated anchors with equal vector and label are searched once; equal scores go to the
smaller vec_id; scores beyond a long are ranked exactly and returned as the nearest long;
an empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.llm.collision_search import matrix
from dutyweave.staging import stage

SCALE = 256
#: Rows of a block, at least and at most; between them a 64th of all rows.
BLOCK_ROWS = (1024, 32_768)
#: Anchors that one task scores against one block.
ANCHOR_ROWS = 4096
#: Scores that are held at a time.
TILE = 1 << 22
#: Bits of the integers that doubles hold exactly.
EXACT_BITS = 53


def usable(vectors: DataFrame, relabel_every: int, labels: int) -> DataFrame:
    """(vec_id, label, v): rows that take part, some of them with the next label."""
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & (F.size("v") > 0)
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()).where(F.coalesce(fine, F.lit(False)))
    width = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    moved = F.when(F.col("vec_id") % relabel_every == 0, (F.col("label") + 1) % labels).otherwise(F.col("label"))
    return rows.where(F.size("v") == (width["d"] if width else 0)).select("vec_id", moved.alias("label"), "v")


def whole(x: np.ndarray, scale: int = SCALE) -> np.ndarray:
    """floor(scale * x): doubles where they are exact, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(x * scale)
    if np.isfinite(y).all():
        return y
    return np.array([[math.floor(v * scale) if abs(v) < 2.0**53 else int(v) * scale for v in row] for row in x.tolist()], object)


class Packed:
    """Candidates of a block, several in one wide integer for each dimension."""

    def __init__(self, candidates: np.ndarray, anchors: np.ndarray) -> None:
        c, a = whole(candidates), whole(anchors)
        low = int(min(c.min(), a.min(), 0))
        self.bias = -low
        high = int(max(c.max(), a.max(), 0)) + self.bias
        d = c.shape[1]
        self.field = max(1, (d * high * high).bit_length())
        self.rows = len(c)
        self.narrow = 2 * self.field <= EXACT_BITS or self.field + self.rows.bit_length() < EXACT_BITS
        kind = np.float64 if self.narrow else object
        if not self.narrow:
            c, a = (np.array([[int(v) for v in row] for row in x], object) for x in (c, a))
        self.c, self.a = c.astype(kind) + self.bias, a.astype(kind) + self.bias
        self.fields = EXACT_BITS // self.field if self.narrow else self.rows
        self.shift = self.bias * (self.c.sum(1) + 0), self.bias * self.a.sum(1), d * self.bias * self.bias
        size = -(-self.rows // self.fields)
        padded = np.zeros((size * self.fields, d), kind)
        padded[: self.rows] = self.c
        lanes = padded.reshape(self.fields, size, d)  # field k of a wide integer holds candidate k * size + its place
        self.wide = lanes[0].copy()
        for k in range(1, self.fields):
            self.wide += lanes[k] * (1 << (k * self.field))

    def scores(self, some: slice) -> np.ndarray:
        """Exact inner products of some anchors with all candidates."""
        if self.narrow:
            sums = (self.a[some] @ self.wide.T).astype(np.int64)
            mask = (1 << self.field) - 1
            biased = np.concatenate([(sums >> (k * self.field)) & mask for k in range(self.fields)], 1)[:, : self.rows]
            c, a, all_ = (np.asarray(x).astype(np.int64) for x in self.shift)
            return biased - c - a[some][:, None] + all_
        mask = (1 << self.field) - 1
        out = np.empty((len(self.a[some]), self.rows), object)
        for i, anchor in enumerate(self.a[some]):
            total = sum(x * y for x, y in zip(anchor, self.wide[0]))
            out[i] = [(total >> (k * self.field)) & mask for k in range(self.rows)]
        return out - self.shift[0] - self.shift[1][some][:, None] + self.shift[2]


def _in_long(x: np.ndarray) -> np.ndarray:
    return x if x.dtype == np.int64 else np.array([min(max(int(v), -(1 << 63)), (1 << 63) - 1) for v in x], np.int64)


def _first(score: np.ndarray, may: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best scores that may count; candidates come by vec_id, so that ties go to the smaller one."""
    at = np.flatnonzero(may)
    if len(at) > 4 * k and score.dtype != object:
        least = np.partition(score[at], len(at) - k)[len(at) - k]
        at = at[score[at] >= least]
    if score.dtype == object:
        return np.array(sorted(at.tolist(), key=lambda i: -score[i])[:k], np.int64)
    return at[np.argsort(-score[at], kind="stable")[:k]]


def mine(vectors: DataFrame, anchor_every: int = 100, relabel_every: int = 7, labels: int = 10, positives: int = 5, negatives: int = 5, percent: int = 80, block_rows: tuple[int, int] = BLOCK_ROWS) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive that has negatives.

    Negatives are rows of another label that score percent to 100 percent of the positive's score.
    """
    rows = stage(usable(vectors, relabel_every, labels).withColumn("s", F.monotonically_increasing_id()), "labelled-vectors")
    count = rows.count()
    blocks = max(1, math.ceil(count / min(block_rows[1], max(block_rows[0], count // 64))))
    index = rows.select(F.pmod(F.xxhash64("s"), F.lit(blocks)).cast("int").alias("b"), "vec_id", "label", "v")
    asked = rows.where(F.col("vec_id") % anchor_every == 0).groupBy("vec_id", "label", "v").agg(F.min("s").alias("s"))
    groups = max(1, math.ceil(count / anchor_every / ANCHOR_ROWS))
    asked = asked.select(F.pmod(F.xxhash64("s", F.lit(1)), F.lit(groups)).cast("int").alias("g"), F.col("s").alias("anchor"), F.col("vec_id").alias("anchor_id"), "label", "v")
    copied = index.withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(visits: DataFrame, found: dict[str, type], pick) -> DataFrame:
        """pick(anchor's row, scores, labels, ids) of every anchor in every block."""

        def run(left: pa.Table, right: pa.Table) -> pa.Table:
            out: dict[str, list] = {k: [] for k in found}
            if left.num_rows and right.num_rows:
                left = left.sort_by("vec_id")
                ids, label = left.column("vec_id").to_numpy(), left.column("label").to_numpy()
                packed = Packed(matrix(left.column("v")), matrix(right.column("v")))
                asked = right.drop_columns(["v"]).to_pylist()
                for a in range(0, len(asked), step := max(1, TILE // len(ids))):
                    for row, score in zip(asked[a : a + step], packed.scores(slice(a, a + step))):
                        pick(out, row, score, label, ids)
            return pa.table({k: pa.array(np.concatenate(v) if v else np.zeros(0, kind), type=pa.from_numpy_dtype(kind)) for (k, kind), v in zip(found.items(), out.values())})

        shape = ", ".join(f"{k} long" for k in found)
        spread = visits.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
        return copied.groupBy("b", "g").cogroup(spread.groupBy("b", "g")).applyInArrow(run, shape)

    def pick_positives(out: dict, row: dict, score: np.ndarray, label: np.ndarray, ids: np.ndarray) -> None:
        at = _first(score, (label == row["label"]) & (ids != row["anchor_id"]), positives)
        out["anchor"].append(np.full(len(at), row["anchor"]))
        out["positive_id"].append(ids[at])
        out["positive_score"].append(_in_long(score[at]))

    def pick_negatives(out: dict, row: dict, score: np.ndarray, label: np.ndarray, ids: np.ndarray) -> None:
        other = (label != row["label"]) & (ids != row["anchor_id"])
        for nth, most in enumerate(row["scores"]):
            at = _first(score, other & (100 * score >= percent * most) & (score <= most), negatives)
            out["anchor"].append(np.full(len(at), row["anchor"]))
            out["nth"].append(np.full(len(at), nth))
            out["negative_id"].append(ids[at])
            out["negative_score"].append(_in_long(score[at]))

    def best(found: DataFrame, key: list[str], score: str, by: str, k: int) -> DataFrame:
        return found.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc(score), by))).where(F.col("rank") <= k)

    asked = stage(asked, "anchors")
    kinds = dict.fromkeys(["anchor", "positive_id", "positive_score"], np.int64)
    near = best(meet(asked, kinds, pick_positives), ["anchor"], "positive_score", "positive_id", positives)
    held = near.groupBy("anchor").agg(F.array_sort(F.collect_list(F.struct("rank", "positive_id", "positive_score"))).alias("p"))  # at most `positives` each
    held = stage(asked.join(held, "anchor"), "positives")
    visits = held.select("g", "anchor", "anchor_id", "label", "v", F.col("p.positive_score").alias("scores"))
    kinds = dict.fromkeys(["anchor", "nth", "negative_id", "negative_score"], np.int64)
    hard = best(meet(visits, kinds, pick_negatives), ["anchor", "nth"], "negative_score", "negative_id", negatives)
    named = held.select("anchor", "anchor_id", F.posexplode("p").alias("nth", "p")).select("anchor", "anchor_id", "nth", "p.positive_id", "p.positive_score")
    joined = hard.join(named, ["anchor", "nth"])
    return joined.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH r AS (SELECT CAST(vec_id AS BIGINT) AS i, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS l,
    list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.i AS a, c.i AS c, a.l = c.l AS same, CAST(list_inner_product(a.v, c.v) AS BIGINT) AS n FROM r a JOIN r c ON a.i % 100 = 0 AND c.i <> a.i),
p AS (SELECT a, c, n FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY n DESC, c) <= 5)
SELECT p.a AS anchor_id, p.c AS positive_id, row_number() OVER (PARTITION BY p.a, p.c ORDER BY s.n DESC, s.c) AS rank, s.c AS negative_id,
  p.n AS positive_score, s.n AS negative_score
FROM p JOIN s ON s.a = p.a AND NOT s.same AND 80 * p.n <= 100 * s.n AND s.n <= p.n
QUALIFY rank <= 5
"""
