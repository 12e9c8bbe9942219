"""Packing of documents into sequences of bounded length by the sum of squares.

A document's tokens, with an end mark, that exceed the capacity are cut into whole pieces
behind a shorter first one. A whole piece is a sequence of its own. Each other piece goes
where the squared counts of open sequences, one count for each residual gap, sum to the
least: into an open sequence or a new one.

Where a piece goes depends on its length alone, so the rule is run on the counts of
lengths, of which there are fewer than the capacity, however many documents there are.
Long pieces are placed first; sequences that stay with a gap above a LOOSE-th of the capacity
are taken apart again, and their pieces are placed anew, as long as that closes more. Beyond
PLAN_PIECES pieces one part stands for `times` equal parts: it is packed once, its closed
sequences are taken `times` times, and what the division left goes to the next, smaller
round. The plan says for the r-th piece of a length which sequence it joins and where. Ranks come from windows
over salted lengths and the salts' running totals, so that no length is gathered in one
task.

Defined results for odd input: a null or empty text is its end mark alone; very long texts
become many pieces; a null doc_id is kept; repeated rows are documents of their own; equal
lengths are ranked by the written table's row order; an empty table gives an empty result;
other columns are ignored, whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.llm.batches import per_batch, small_batches
from dutyweave.llm.chunk_tokens import ByteEncoder, ChunkStore, Ragged, slices
from dutyweave.staging import stage

BYTE_TOKENS = "byte_bpe_50k.json"
END = 2
CAPACITY = 1024
#: Pieces that are placed one by one in a round of the plan.
PLAN_PIECES = 1 << 17
#: A sequence counts as closed when its gap is at most this part of the capacity.
LOOSE = 64
#: Pieces of one length that are ranked together, at least; for many pieces the square root of their number.
RANKED = 512


class Encoder:
    """A byte-level tokenizer and the distinct chunks that a worker has seen."""

    def __init__(self, byte_tokens: str) -> None:
        self.of_bytes = ByteEncoder(byte_tokens, special_as_text=False)
        self.store = ChunkStore(self._learn, self._forget, first_differs=True)
        self._forget()

    def _forget(self) -> None:
        self.ids = Ragged()

    def _learn(self, chunks: list[str], first: list[bool]) -> None:
        self.ids.extend(self.of_bytes.encode([c if f else " " + c for c, f in zip(chunks, first)]))

    def encode(self, texts: list[str | None], end: int) -> list[np.ndarray]:
        """Ids of each text, with the end mark."""
        rows = self.store.numbers([t or "" for t in texts])
        found: list[list[np.ndarray]] = [[] for _ in rows]
        for of, bound, chunks in slices(rows):
            ids, cut = self.ids.take(chunks), np.append(0, np.cumsum(self.ids.sizes(chunks)))[bound]
            for k, row in enumerate(of.tolist()):
                found[row].append(ids[cut[k] : cut[k + 1]])
        return [np.concatenate([*f, np.array([end], np.int32)]) for f in found]


_encoders: dict[str, Encoder] = {}


def encoder(byte_tokens: str) -> Encoder:
    """The worker's encoder of this tokenizer."""
    if byte_tokens not in _encoders:
        _encoders[byte_tokens] = Encoder(byte_tokens)
    return _encoders[byte_tokens]


def pieces(docs: DataFrame, byte_tokens: str = BYTE_TOKENS, end: int = END, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every piece of every row of docs; with_ids: its ids too."""
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        ids = encoder(byte_tokens).encode(batch.column("text").to_pylist(), end)
        size = np.array([len(x) for x in ids], np.int64)
        count = -(-size // capacity)
        row = np.repeat(np.arange(len(ids)), count)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        first = size - (count - 1) * capacity
        start = np.where(piece == 0, 0, first[row] + (piece - 1) * capacity)
        length = np.where(piece == 0, first[row], capacity)
        cut = [ids[r][a : a + n].astype("<u4") for r, a, n in zip(row.tolist(), start.tolist(), length.tolist())]
        columns = [batch.column("doc_id").take(pa.array(row)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(c) for c in cut], pa.int64())]
        names = ["doc_id", "piece", "start", "length", "ids_crc32"]
        if with_ids:
            columns.append(pa.array([c.astype(np.int32) for c in cut], pa.list_(pa.int32())))
            names.append("ids")
        return pa.record_batch(columns, names)

    shape = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(per_batch(run), shape)


def place_all(lengths: Iterator[int], capacity: int) -> list[list[int]]:
    """Sequences, each the lengths of its pieces in order of placing."""
    free = np.zeros(capacity + 1, np.int64)  # open sequences of each residual gap
    lose, gain = np.full(capacity + 1, 1 << 60, np.int64), 2 * free + 1  # change of the sum where a gap loses or gains a sequence
    gain[0], lose[capacity] = 0, 0  # a full sequence is not open; a new one is always there
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    out: list[list[int]] = []

    def count(gap: int, by: int) -> None:
        if 0 < gap < capacity:
            free[gap] += by
            gain[gap] = 2 * free[gap] + 1
            lose[gap] = 1 - 2 * free[gap] if free[gap] else 1 << 60

    for n in lengths:
        gap = n + int(np.argmin(lose[n:] + gain[: capacity + 1 - n]))  # of equally good gaps the smallest
        if gap == capacity:
            out.append([n])
            at = len(out) - 1
        else:
            at = open_at[gap].pop()
            out[at].append(n)
        count(gap, -1)
        count(gap - n, 1)
        open_at[gap - n].append(at)
    return out


def _in_turn(counts: np.ndarray) -> Iterator[int]:
    """The lengths that counts hold, long ones first."""
    return iter(np.repeat(np.arange(len(counts)), counts)[::-1].tolist())


def plan(counts: np.ndarray, capacity: int = CAPACITY, most: int = PLAN_PIECES) -> dict[str, np.ndarray]:
    """Slots (length, rank, sequence, offset): the pieces of a length from rank on go, one each, to the sequences from sequence on, at offset.

    counts[n]: pieces of length n. Sequences are numbered from 0.
    """
    most = max(most, 2 * capacity)  # so that no division leaves every length without a piece
    rest, rounds, kept, best = counts.astype(np.int64).copy(), [], 0, None
    while rest.sum():
        times = int(-(-rest.sum() // most))
        found = Counter(map(tuple, place_all(_in_turn(rest // times), capacity)))
        close = Counter({p: k for p, k in found.items() if capacity - sum(p) <= capacity // LOOSE})
        if times > 1:
            if 2 * sum(len(p) * k for p, k in close.items()) < sum(len(p) * k for p, k in found.items()):
                close = found  # the lengths allow no better
        else:
            total = kept + found.total()
            if best is None or total < best[0]:
                best = total, len(rounds), found
            if not close:
                break
        rounds.append((close, times))
        kept += close.total() * times
        for pattern, k in close.items():
            for n in pattern:
                rest[n] -= k * times
    if best is not None:
        rounds = [*rounds[: best[1]], (best[2], 1)]
    taken, sequences, slots = [0] * len(counts), 0, []
    for close, times in rounds:
        for pattern, k in close.items():
            offset = 0
            for n in pattern:
                slots.append((n, taken[n], sequences, offset))
                taken[n] += k * times
                offset += n
            sequences += k * times
    table = np.array(slots, np.int64).reshape(-1, 4)
    table = table[np.lexsort((table[:, 1], table[:, 0]))]
    return dict(zip(("length", "rank", "sequence", "offset"), table.T.copy())) | {"sequences": np.int64(sequences)}


def pack(cut: DataFrame, capacity: int = CAPACITY, most: int = PLAN_PIECES) -> DataFrame:
    """The rows of cut, from `pieces`, with sequence_id and offset: sequences are gapless from 0 and hold at most capacity tokens.

    A whole piece's sequence has a number below 0.
    """
    spark = cut.sparkSession
    rows = stage(cut.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    whole = rows.where(F.col("length") == capacity).select(*cut.columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    counts = np.zeros(capacity, np.int64)
    for r in rows.where(F.col("length") < capacity).groupBy("length").count().collect():  # fewer rows than the capacity
        counts[r["length"]] = r["count"]
    slots = plan(counts, capacity, most)
    shared = spark.sparkContext.broadcast(slots)
    together = max(RANKED, math.isqrt(int(counts.sum())))
    salts = F.element_at(F.array(*(F.lit(max(1, math.ceil(c / together))) for c in counts.tolist())), F.col("length").cast("int") + 1)
    part = rows.where(F.col("length") < capacity).select("_row", "length", F.pmod(F.xxhash64("_row"), salts).alias("_salt"))
    held = part.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("_held"))
    before = held.select("length", "_salt", (F.sum("_held").over(Window.partitionBy("length").orderBy("_salt")) - F.col("_held")).alias("_before"))
    within = part.withColumn("_nth", F.row_number().over(Window.partitionBy("length", "_salt").orderBy("_row")) - 1)
    ranked = within.join(before, ["length", "_salt"]).select("_row", "length", (F.col("_before") + F.col("_nth")).cast("long").alias("rank"))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        s = shared.value
        length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
        first = np.searchsorted(s["length"], np.arange(capacity + 1))
        at = np.empty(len(length), np.int64)
        for n in np.unique(length).tolist():  # at most the capacity
            mine = length == n
            at[mine] = first[n] + np.searchsorted(s["rank"][first[n] : first[n + 1]], rank[mine], "right") - 1
        return pa.record_batch([batch.column("_row"), pa.array(s["sequence"][at] + rank - s["rank"][at]), pa.array(s["offset"][at])], ["_row", "sequence_id", "offset"])

    placed = ranked.mapInArrow(per_batch(place), "_row long, sequence_id long, offset long")
    packed = rows.where(F.col("length") < capacity).join(placed, "_row").select(*cut.columns, "sequence_id", "offset")
    return packed.unionByName(whole)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): each sequence's tokens in order, and whose they are; packed has ids. A sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    held = packed.groupBy("sequence_id").agg(parts.alias("_p"))
    return held.select("sequence_id", F.flatten(F.col("_p.ids")).alias("ids"), F.col("_p.doc_id").alias("doc_ids"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(pieces(spark.read.parquet(f"{sf_dir}/documents.parquet")))
