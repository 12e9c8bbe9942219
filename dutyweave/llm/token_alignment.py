"""Alignment of two tokenizers' tokens by a galloping intersection of their end offsets.

Tokenizer A (byte-level) and B (pieces) write the same bytes: a blank and the text. The
offsets where tokens end are two ascending lists. The shorter one drives: each of its ends
looks for its place in the longer one, from where a straight line would put it, by steps
that double and then by halving. All ends of a slice gallop together, in numpy. Ends found
in both lists cut the tokens into groups; the places' differences say which tokens of the
other side a token overlaps.

A and B tokens that end together are linked. How often the corpus links a pair of ids is
counted per task and then summed. A document's links meet these counts in a sorted array
of the HOT_PAIRS commonest pairs; further pairs, if there are any, meet theirs in a
shuffled join. Both give exact counts.

Defined results for odd input: a null or empty text, and one that B does not write back
byte by byte (it holds a word mark), has no tokens, zeros and an empty digest; very long
texts are taken in parts that end where a chunk does, with bounded memory; a null doc_id is
kept; repeated rows are documents of their own and count each time; an empty table gives
an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.llm.batches import per_batch, small_batches
from dutyweave.llm.chunk_tokens import ByteEncoder, ChunkStore, Ragged, path, slices
from dutyweave.staging import stage

BYTE_TOKENS = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: Pairs whose counts travel to the tasks: 13 bytes each.
HOT_PAIRS = 1 << 20
#: Distinct pairs that a task sums before it hands them on.
HELD_PAIRS = 1 << 21
#: Ids of A are below this, so that a pair is one integer.
WIDTH = 1 << 16


def gallop(driver: np.ndarray, low: np.ndarray, high: np.ndarray, longer: np.ndarray, guess: np.ndarray) -> np.ndarray:
    """For each driver: the first place in longer[low:high] that holds its value or more. guess: where to start, inside [low, high)."""
    left, right = low.copy(), high.copy()  # the place is always in [left, right]
    below = longer[guess] < driver
    left[below], right[~below] = guess[below] + 1, guess[~below]
    for up, active in ((True, np.flatnonzero(below)), (False, np.flatnonzero(~below))):
        step = 1
        while len(active):
            at = np.minimum(left[active] + step - 1, high[active] - 1) if up else np.maximum(right[active] - step, low[active])
            inside = (left[active] < right[active]) if up else (right[active] > left[active])
            active, at = active[inside], at[inside]
            less = longer[at] < driver[active]
            left[active[less]] = at[less] + 1
            right[active[~less]] = at[~less]
            active = active[less] if up else active[~less]
            step *= 2
    while len(active := np.flatnonzero(left < right)):
        middle = (left[active] + right[active]) // 2
        less = longer[middle] < driver[active]
        left[active[less]] = middle[less] + 1
        right[active[~less]] = middle[~less]
    return left


def common_ends(a_end: np.ndarray, a_bound: np.ndarray, b_end: np.ndarray, b_bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places in a_end and b_end of the ends that both hold. Row i has a_end[a_bound[i]:a_bound[i + 1]], and likewise for b."""
    out = []
    for short, s_bound, longer, l_bound, flip in ((a_end, a_bound, b_end, b_bound, False), (b_end, b_bound, a_end, a_bound, True)):
        s_size, l_size = np.diff(s_bound), np.diff(l_bound)
        rows = np.flatnonzero((s_size < l_size if flip else s_size <= l_size) & (s_size > 0))
        size = s_size[rows]
        nth = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        place = np.repeat(s_bound[rows], size) + nth
        low, high = np.repeat(l_bound[rows], size), np.repeat(l_bound[rows + 1], size)
        guess = low + nth * (high - low) // np.maximum(1, np.repeat(size, size))
        found = gallop(short[place], low, high, longer, guess)
        hit = found < high
        hit[hit] = longer[found[hit]] == short[place[hit]]
        pair = (place[hit], found[hit])
        out.append(pair[::-1] if flip else pair)
    a, b = (np.concatenate([x[k] for x in out]) for k in (0, 1))
    order = np.argsort(a, kind="stable")
    return a[order], b[order]


def overlap_ranges(ends: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each token of one text: the first and the last token of the other side that shares a byte with it, by its ends' places."""
    low, high = np.zeros(len(ends), np.int64), np.full(len(ends), len(other), np.int64)
    guess = np.arange(len(ends)) * len(other) // max(1, len(ends))
    place = gallop(ends, low, high, other, guess)
    reached = np.append(0, place + (other[np.minimum(place, len(other) - 1)] == ends))  # tokens of the other side that end there at the latest
    return reached[:-1], place


class Aligner:
    """Both tokenizers, and the distinct chunks that a worker has seen."""

    def __init__(self, byte_tokens: str, pieces: str) -> None:
        import sentencepiece

        self.of_bytes = ByteEncoder(byte_tokens, special_as_text=True)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path(pieces))
        self.a_bytes = self.of_bytes.bytes_of
        if len(self.a_bytes) > WIDTH:
            raise ValueError(f"tokenizer A has more than {WIDTH} ids")
        piece = [self.sp.id_to_piece(i) for i in range(self.sp.get_piece_size())]
        if any("▁" in p.lstrip("▁") for p in piece):
            raise ValueError("a piece holds a word mark after another character, where texts are cut")
        self.b_bytes = [bytes([int(p[3:-1], 16)]) if self.sp.is_byte(i) else p.replace("▁", " ").encode() for i, p in enumerate(piece)]
        self.a_size, self.b_size = (np.array([len(x) for x in y], np.int64) for y in (self.a_bytes, self.b_bytes))
        number = [str(i) for i in range(max(len(piece), len(self.a_bytes)))]
        self.says = [x + end for end in (",", "|", ";") for x in number]
        self.kinds = len(number)
        self.store = ChunkStore(self._learn, self._forget, first_differs=False)
        self._forget()

    def _forget(self) -> None:
        self.a, self.b, self.good = Ragged(), Ragged(), np.zeros(0, bool)

    def _learn(self, chunks: list[str], _: list[bool]) -> None:
        a = self.of_bytes.encode([" " + c for c in chunks])
        b = self.sp.encode(chunks, num_threads=1)
        self.a.extend(a)
        self.b.extend(b)
        fine = np.ones(len(chunks), bool)
        if not self._same(chunks, a, b):
            fine = np.array([self._same([c], [x], [y]) for c, x, y in zip(chunks, a, b)], bool)
        self.good = np.concatenate([self.good, fine])

    def _same(self, chunks: list[str], a: list[list[int]], b: list[list[int]]) -> bool:
        """Whether both write these chunks, each behind a blank, byte by byte."""
        said = " ".join(["", *chunks]).encode()
        return all(b"".join(map(of.__getitem__, chain.from_iterable(ids))) == said for of, ids in ((self.a_bytes, a), (self.b_bytes, b)))

    def align(self, texts: list[str | None], with_groups: bool) -> dict[str, list]:
        """Of each text: numbers of tokens, groups and links, the groups' digest, and its distinct links with their numbers."""
        rows = self.store.numbers([t or "" for t in texts])
        rows = [r if len(r) and self.good[r].all() else r[:0] for r in rows]
        n = len(rows)
        counts = np.zeros((3, n), np.int64)
        digest = [hashlib.sha256() for _ in rows]
        groups: list[list[str]] = [[] for _ in rows]
        links: list[list[np.ndarray]] = [[] for _ in rows]
        for of, bound, chunks in slices(rows):
            a, b = self.a.take(chunks), self.b.take(chunks)
            a_bound, b_bound = (np.append(0, np.cumsum(r.sizes(chunks)))[bound] for r in (self.a, self.b))
            i, j = common_ends(np.cumsum(self.a_size[a]), a_bound, np.cumsum(self.b_size[b]), b_bound)
            code = b[j].astype(np.int64) * WIDTH + a[i]
            cut = np.searchsorted(i, a_bound)
            # tokens in order of writing: a group's A tokens, then its B tokens
            size_a, size_b = np.diff(i, prepend=-1), np.diff(j, prepend=-1)
            said = np.empty(len(a) + len(b), np.int64)
            a_place = np.arange(len(a)) + np.repeat(j + 1 - size_b, size_a)
            b_place = np.arange(len(b)) + np.repeat(i + 1, size_b)
            said[a_place], said[b_place] = a, b
            said[a_place[i]] += self.kinds
            said[b_place[j]] += 2 * self.kinds
            written = list(map(self.says.__getitem__, said.tolist()))
            for k, row in enumerate(of.tolist()):
                counts[:, row] += a_bound[k + 1] - a_bound[k], b_bound[k + 1] - b_bound[k], cut[k + 1] - cut[k]
                part = "".join(written[a_bound[k] + b_bound[k] : a_bound[k + 1] + b_bound[k + 1]])
                groups[row].append(part) if with_groups else None
                if links[row]:
                    digest[row].update(b";")
                digest[row].update(part[:-1].encode())
                links[row].append(code[cut[k] : cut[k + 1]])
        pair, times = [], []
        for parts in links:
            code, count = np.unique(np.concatenate(parts), return_counts=True) if parts else (np.zeros(0, np.int64), np.zeros(0, np.int64))
            pair.append(code.astype(np.uint32).tobytes())
            times.append(count.astype(np.uint32).tobytes())
        return {
            "n_a": counts[0], "n_b": counts[1], "n_groups": counts[2], "groups_sha256": [d.hexdigest() if c else "" for d, c in zip(digest, counts[2].tolist())],
            "pairs": pair, "times": times, "groups": ["".join(g)[:-1] for g in groups] if with_groups else [None] * n,
        }


_aligners: dict[tuple[str, str], Aligner] = {}


def aligner(byte_tokens: str, pieces: str) -> Aligner:
    """The worker's aligner of these two tokenizers."""
    key = (byte_tokens, pieces)
    if key not in _aligners:
        _aligners[key] = Aligner(*key)
    return _aligners[key]


def _aligned(docs: DataFrame, byte_tokens: str, pieces: str, with_groups: bool) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = aligner(byte_tokens, pieces).align(batch.column("text").to_pylist(), with_groups)
        kinds = {"pairs": pa.binary(), "times": pa.binary(), "groups": pa.string(), "groups_sha256": pa.string()}
        return pa.record_batch([batch.column("row"), batch.column("doc_id"), *(pa.array(v, kinds.get(k, pa.int64())) for k, v in found.items())], ["row", "doc_id", *found])

    ready = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(per_batch(run), "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, pairs binary, times binary, groups string")


def _codes(cells: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the rows' binary cells, and the rows' bounds."""
    return np.frombuffer(b"".join(cells), np.uint32).astype(np.int64), np.cumsum([0, *(len(c) // 4 for c in cells)])


def pair_counts(aligned: DataFrame) -> DataFrame:
    """(pair, n, best): how often the corpus links each pair of ids, and whether no other pair of its B id is linked more often."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, n = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            code, times = _codes(batch.column("pairs").to_pylist())[0], _codes(batch.column("times").to_pylist())[0]
            pair, at = np.unique(np.concatenate([pair, code]), return_inverse=True)
            n = np.bincount(at, np.concatenate([n, times]), len(pair)).astype(np.int64)  # below 2^53
            if len(pair) > HELD_PAIRS:
                yield pa.record_batch([pa.array(pair), pa.array(n)], ["pair", "n"])
                pair, n = pair[:0], n[:0]
        if len(pair):
            yield pa.record_batch([pa.array(pair), pa.array(n)], ["pair", "n"])

    counted = aligned.select("pairs", "times").mapInArrow(run, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    most = F.max("n").over(Window.partitionBy(F.shiftright("pair", 16)))  # at most WIDTH rows a key
    return counted.withColumn("best", F.col("n") == most)


def align(docs: DataFrame, byte_tokens: str = BYTE_TOKENS, pieces: str = PIECES, with_groups: bool = False, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256) of every row of docs; with_groups: their groups too."""
    spark = docs.sparkSession
    small_batches(spark)
    aligned = stage(_aligned(docs, byte_tokens, pieces, with_groups), "aligned")
    counts = stage(pair_counts(aligned), "pair-counts")
    hot = counts.orderBy(F.desc("n"), "pair").limit(hot_pairs).toArrow()
    order = np.argsort(hot.column("pair").to_numpy())
    shared = spark.sparkContext.broadcast(tuple(hot.column(k).to_numpy(zero_copy_only=False)[order] for k in ("pair", "n", "best")))

    def known(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        pair = shared.value[0]
        if not len(pair):
            return np.zeros(len(code), np.int64), np.zeros(len(code), bool)
        at = np.minimum(np.searchsorted(pair, code), len(pair) - 1)
        return at, pair[at] == code

    def total(batch: pa.RecordBatch) -> pa.RecordBatch:
        (code, bound), (times, _) = (_codes(batch.column(k).to_pylist()) for k in ("pairs", "times"))
        at, found = known(code)
        _, n, best = shared.value
        gains = [np.where(found, times * x[at], 0) if len(n) else np.zeros(len(code), np.int64) for x in (best, n)]
        sums = [np.diff(np.append(0, np.cumsum(g))[bound]) for g in gains]
        return pa.record_batch([*(batch.column(k) for k in kept), *(pa.array(s.astype(np.int64)) for s in sums)], [*kept, "n_best", "count_sum"])

    def others(batch: pa.RecordBatch) -> pa.RecordBatch:
        (code, bound), (times, _) = (_codes(batch.column(k).to_pylist()) for k in ("pairs", "times"))
        row = np.repeat(batch.column("row").to_numpy(), np.diff(bound))
        rest = ~known(code)[1]
        return pa.record_batch([pa.array(row[rest]), pa.array(code[rest]), pa.array(times[rest])], ["row", "pair", "times"])

    kept = ["row", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", *(["groups"] if with_groups else [])]
    shape = "row long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, " + ("groups string, " if with_groups else "") + "n_best long, count_sum long"
    scored = aligned.select(*kept, "pairs", "times").mapInArrow(per_batch(total), shape)
    if counts.count() > hot.num_rows:
        rest = aligned.select("row", "pairs", "times").mapInArrow(per_batch(others), "row long, pair long, times long").join(counts, "pair")
        more = rest.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("_best"), F.sum(F.col("times") * F.col("n")).alias("_sum"))
        scored = scored.join(more, "row", "left").withColumn("n_best", F.col("n_best") + F.coalesce("_best", F.lit(0)))
        scored = scored.withColumn("count_sum", F.col("count_sum") + F.coalesce("_sum", F.lit(0)))
    # tokens have at least a byte, so one pair ends at each common end
    return scored.withColumn("n_links", F.col("n_groups")).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", *kept[6:])


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align(spark.read.parquet(f"{sf_dir}/documents.parquet"))
