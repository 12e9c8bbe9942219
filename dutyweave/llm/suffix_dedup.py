"""Repeated passages removed by suffix arrays (Larsson-Sadakane refinement, Kasai common prefixes).

Every byte covered by a WINDOW-byte string that also starts in a document with a
smaller doc_id is removed. Sorting all suffixes of a corpus together would move
WINDOW bytes for each byte of text, so the suffixes that can matter are found first,
without loss: each window has an anchor, the GRAM-byte piece of smallest hash in it
(leftmost of equals). Equal windows have equal anchors, so a window can only repeat
where its anchor does.

1. Anchors are found once, where documents are read, and travel with the text as two
   bytes each. Documents are dealt to shards of bounded size. A shard lists its anchors
   with the hash of their surroundings (all windows the anchor serves) and the smallest
   doc_id.
2. Anchors meet by hash. One that occurs once needs nothing; one with equal
   surroundings everywhere is decided; the others, where passages begin, end or differ,
   ask their shards for the surroundings' text.
3. These texts are sorted: blocks of bounded size get a suffix array by prefix doubling
   that refines only unsorted groups, common prefixes are found by Kasai's walk (one
   lane a text, all lanes at once), and the sorted distinct windows of further blocks are
   merged in by binary search. Every window learns the smallest document that holds it.
4. Shards apply both answers to their documents.

A shard lists at most MANY surroundings of an anchor. An anchor with that many in all, not
all equal, is hot: its windows are sorted one by one instead, each distinct window once a
shard with the smallest doc_id there, dealt by the hash of the whole window. So no task
holds all surroundings of a hot anchor, and equal windows still meet. Fewer surroundings than that are at most MANY * 80
bytes in one task. Rows without a doc_id pass by the shards, and rows that share a doc_id are dealt by their texts too.

Defined results for odd input: a null text counts as empty; texts shorter than WINDOW
bytes lose nothing; a null doc_id loses nothing and removes nothing; rows with the same
doc_id do not count as smaller than each other; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyweave.llm.batches import per_batch, small_batches
from dutyweave.staging import stage

WINDOW = 50
GRAM = 20
PER = WINDOW - GRAM + 1
SHARD_BYTES = 8 << 20
BUCKET_BYTES = 4 << 20
SEGMENT = (1 << 20) - 64
BLOCK_BYTES = 1 << 20
#: Distinct surroundings from which on an anchor is hot; fewer are 164 kB of text at most.
MANY = 2048
#: Buckets for windows of hot anchors, for each ordinary one.
HOT_SPREAD = 4
FACTORS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
LOW48 = np.uint64((1 << 48) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(29))


def _eights(data: np.ndarray) -> np.ndarray:
    """Unaligned view: the eight bytes at every position."""
    return np.ndarray((len(data) - 7,), np.dtype("<u8"), data.data if data.flags.writeable else data.copy().data, 0, (1,))


def _gram(w: np.ndarray, a, b, c) -> np.ndarray:
    with np.errstate(over="ignore"):
        return _mix(w[a] * FACTORS[0] + w[b] * FACTORS[1] + w[c] * FACTORS[2])


def gram_at(w: np.ndarray, p: np.ndarray) -> np.ndarray:
    return _gram(w, p, p + 8, p + GRAM - 8)


def anchors(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchor, first window, last window) positions over documents [start, end) of one buffer, padded by 64 bytes."""
    valid = np.ones(max(0, len(data) - 64), bool)
    for s, e in zip(start.tolist(), end.tolist()):
        valid[max(s, e - WINDOW + 1) : e] = False
    found: list[np.ndarray] = []
    w = _eights(data)
    for a in range(0, len(valid), SEGMENT):
        b = min(len(valid), a + SEGMENT)
        at = np.flatnonzero(valid[a:b])
        if not len(at):
            continue
        n = int(at[-1]) + PER
        h = _gram(w, slice(a, a + n), slice(a + 8, a + 8 + n), slice(a + GRAM - 8, a + GRAM - 8 + n))
        key = (h & ~np.uint64((1 << 20) - 1)) | np.arange(n, dtype=np.uint64)
        for step in (1, 2, 4, 8):
            key = np.minimum(key[:-step], key[step:])
        key = np.minimum(key[: -(PER - 16)], key[PER - 16 :])
        owner = (key[at] & np.uint64((1 << 20) - 1)).astype(np.int64) + a
        found.append(np.stack([owner, at + a]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none
    owner, window = np.concatenate(found, 1)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    last = np.append(first[1:], len(owner)) - 1
    return owner[first], window[first], window[last]


def marks(texts: list[bytes]) -> list[bytes]:
    """For each text the offset of every anchor in its first window, then the number of windows it serves; windows follow each other without a gap."""
    size = np.array([len(t) for t in texts], np.int64)
    end = np.cumsum(size)
    anchor, lo, hi = anchors(np.frombuffer(bytearray(b"".join(texts) + bytes(64)), np.uint8), end - size, end)
    cut = np.searchsorted(anchor, np.append(0, end))
    offset, count = (anchor - lo).astype(np.uint8), (hi - lo + 1).astype(np.uint8)
    return [offset[a:b].tobytes() + count[a:b].tobytes() for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


class Shard:
    """Documents of one shard in order of doc_id, their anchors, and the distinct (anchor, surroundings) entries."""

    def __init__(self, table: pa.Table) -> None:
        ids, texts, marked = (table.column(c).to_pylist() for c in ("doc_id", "text", "marks"))
        order = sorted(range(len(ids)), key=ids.__getitem__)
        self.ids = [ids[i] for i in order]
        raw = [texts[i].encode("utf-8", "surrogatepass") for i in order]
        size = np.array([len(r) for r in raw], np.int64)
        self.end = np.cumsum(size)
        self.start = self.end - size
        self.data = np.frombuffer(bytearray(b"".join(raw) + bytes(64)), np.uint8)
        held = np.array([len(marked[i]) // 2 for i in order], np.int64)
        offset = np.frombuffer(b"".join(marked[i][: len(marked[i]) // 2] for i in order), np.uint8).astype(np.int64)
        count = np.frombuffer(b"".join(marked[i][len(marked[i]) // 2 :] for i in order), np.uint8).astype(np.int64)
        self.doc = np.repeat(np.arange(len(order)), held)
        before = np.cumsum(count) - count
        first = np.cumsum(held) - held  # the place of each document's first anchor
        self.lo = self.start[self.doc] + before - np.append(before, 0)[first][self.doc]
        self.anchor, self.hi = self.lo + offset, self.lo + count - 1
        w = _eights(self.data)
        number = np.array(self.ids, np.int64)
        h = gram_at(w, self.anchor) >> np.uint64(16)
        with np.errstate(over="ignore"):
            near = gram_at(w, self.lo) * FACTORS[0] + gram_at(w, self.lo + GRAM) * FACTORS[1]
            near = _mix(near) * FACTORS[2] + gram_at(w, np.minimum(self.lo + 2 * GRAM, self.hi + PER - 1)) * FACTORS[3] + gram_at(w, self.hi + PER - 1) * FACTORS[4]
            near = _mix(near + ((self.anchor - self.lo) * 64 + self.hi - self.lo).astype(np.uint64) * FACTORS[5]) & LOW48
        with np.errstate(over="ignore"):  # anchors are in order of doc_id, so the first of equal ones has the smallest
            order = np.argsort(h * FACTORS[1] + near * FACTORS[2], kind="stable")
        h, near = h[order], near[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (near[1:] != near[:-1])
        head = order[new]
        self.entry = np.empty(len(h), np.int64)
        self.entry[order] = np.cumsum(new) - 1
        self.h, self.near, self.least, self.head = h[new], near[new], number[self.doc[head]], head
        self.number = number
        self.by: tuple[int, int] | None = None

    def by_bucket(self, buckets: int, many: int = MANY) -> tuple[np.ndarray, np.ndarray]:
        """Listed entries (the first `many` of each anchor) in order of bucket, and where each bucket begins."""
        if self.by == (buckets, many):
            return self.listed
        order = np.argsort(self.h, kind="stable")
        h = self.h[order]
        first = np.flatnonzero(np.concatenate([np.ones(min(1, len(h)), bool), h[1:] != h[:-1]]))
        rank = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
        listed = np.sort(order[rank < many])
        of = (self.h[listed] % np.uint64(buckets)).astype(np.int64)
        self.by, self.listed = (buckets, many), (listed[np.argsort(of, kind="stable")], np.append(0, np.cumsum(np.bincount(of, minlength=buckets))))
        return self.listed

    def windows_of(self, entry: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of all windows of these entries' anchors: entry, bit, number; and of each number: position, hash, smallest doc_id. Equal windows share a number."""
        mine = np.flatnonzero(np.isin(self.h, self.h[entry]))
        lo = self.lo[self.head[mine]]
        count = self.hi[self.head[mine]] - lo + 1
        bit = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        at, owner, w = np.repeat(lo, count) + bit, np.repeat(mine, count), _eights(self.data)
        with np.errstate(over="ignore"):
            hashed = _mix(gram_at(w, at) * FACTORS[0] + gram_at(w, at + GRAM) * FACTORS[1] + gram_at(w, at + WINDOW - GRAM) * FACTORS[2])
        order = np.argsort(hashed, kind="stable")
        sorted_at = at[order]
        new = np.ones(len(order), bool)
        new[1:] = hashed[order][1:] != hashed[order][:-1]
        for step in (*range(0, WINDOW - 8, 8), WINDOW - 8):  # bytes decide; a clash of hashes only lists a window twice
            x = w[sorted_at + step]
            new[1:] |= x[1:] != x[:-1]
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        least = np.minimum.reduceat(self.least[owner][order], first) if len(first) else np.zeros(0, np.int64)
        return owner, bit, number, sorted_at[first], hashed[order][first], least

    def answers(self, table: pa.Table, buckets: int, part: str, many: int = MANY) -> tuple[np.ndarray, np.ndarray]:
        """Entry and code of every answer of one part."""
        order, begin = self.by_bucket(buckets, many)
        entries, codes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint32)]
        for b, p, where, code in zip(*(table.column(c).to_pylist() for c in ("bucket", "part", "place", "code")), strict=True):
            if p == part:
                entries.append(order[begin[b] + np.frombuffer(where, np.uint32).astype(np.int64)])
                codes.append(np.frombuffer(code, np.uint32))
        return np.concatenate(entries), np.concatenate(codes)


def suffix_array(text: np.ndarray, lane: np.ndarray) -> np.ndarray:
    """Suffix array of texts that each end in a 0, bytes counting from 1; a suffix ends with its text, ties go by text.

    Groups start from the first seven characters; each doubling sorts only groups which are still unsorted.
    """
    n = len(text)
    padded = np.append(text, np.zeros(7, text.dtype)).astype(np.uint64)
    key, over = np.zeros(n, np.uint64), np.zeros(n, bool)
    for i in range(7):
        over |= padded[i : i + n] == 0
        key = (key << np.uint64(9)) | np.where(over, np.uint64(0), padded[i : i + n])
    sa = np.argsort(key)
    short = np.flatnonzero(over[sa])  # these are sorted now, but for ties: by text
    sa[short] = sa[short][np.lexsort((lane[sa[short]], key[sa[short]]))]
    same = (key[sa][1:] == key[sa][:-1]) & ~over[sa][1:]
    rank, depth = np.empty(n, np.int64), 7
    rank[sa] = np.maximum.accumulate(np.concatenate([[0], np.where(same, 0, np.arange(1, n))]))
    while True:
        r = rank[sa]
        loose = np.zeros(n, bool)
        loose[1:] |= r[1:] == r[:-1]
        loose[:-1] |= r[1:] == r[:-1]
        at = np.flatnonzero(loose)
        if not len(at):
            return sa
        item = sa[at]
        ahead = rank[item + depth]  # an unsorted suffix is longer than depth
        order = np.argsort(r[at] << 32 | ahead)
        item, ahead, group = item[order], ahead[order], r[at][order]
        sa[at] = item
        new = np.ones(len(at), bool)
        new[1:] = (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])
        rank[item] = np.maximum.accumulate(np.where(new, at, 0))
        depth *= 2


def kasai(text: np.ndarray, sa: np.ndarray, start: np.ndarray, size: np.ndarray, most: int = WINDOW) -> np.ndarray:
    """Common prefix (up to most) of each suffix with the one before it in sa; texts are walked side by side, a lane each."""
    n = len(text)
    place = np.empty(n, np.int64)
    place[sa] = np.arange(n)
    before = np.where(place > 0, sa[np.maximum(place - 1, 0)], -1)
    lcp, length = np.zeros(n, np.int64), np.zeros(len(start), np.int64)
    for t in range(int(size.max(initial=0))):
        lane = np.flatnonzero(size > t)
        i = start[lane] + t
        j, k = before[i], np.maximum(length[lane] - 1, 0)
        k[j < 0] = 0
        go = np.flatnonzero(j >= 0)
        while len(go):
            x, y = text[i[go] + k[go]], text[j[go] + k[go]]
            go = go[(x == y) & (x != 0)]
            k[go] += 1
            go = go[k[go] < most]
        length[lane] = k
        lcp[i] = k
    return lcp


def smallest_holders(texts: list[bytes], holder: np.ndarray, block_bytes: int = BLOCK_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """For every window of every text: (text index, smallest holder of that window among all texts), text by text."""
    size = np.array([len(t) for t in texts], np.int64)
    block = np.cumsum(size + 1) // block_bytes
    runs = []
    for b in np.unique(block):
        mine = np.flatnonzero(block == b)
        width = size[mine]
        start = np.cumsum(width + 1) - width - 1
        raw = np.frombuffer(b"\0".join(texts[i] for i in mine) + b"\0", np.uint8)
        text = raw.astype(np.uint16) + 1
        text[start + width] = 0
        sa = suffix_array(text, np.repeat(np.arange(len(mine)), width + 1))
        lcp = kasai(text, sa, start, width)
        count = np.maximum(width - WINDOW + 1, 0)
        at = np.repeat(start - (np.cumsum(count) - count), count) + np.arange(int(count.sum()))
        whose = np.repeat(mine, count)
        place = np.empty(len(text), np.int64)
        place[sa] = np.arange(len(text))
        cls = np.cumsum(lcp[sa] < WINDOW)[place[at]]
        names, first, back = np.unique(cls, return_index=True, return_inverse=True)
        least = np.full(len(names), np.iinfo(np.int64).max)
        np.minimum.at(least, back, holder[whose])
        runs.append([raw, at[first], least, whose, back])
    if len(runs) > 1:  # distinct windows of the blocks are in sorted order: merge them by binary search
        strings = [np.lib.stride_tricks.sliding_window_view(r[0], WINDOW)[r[1]].copy().view(f"S{WINDOW}")[:, 0] for r in runs]
        for i in range(len(runs)):
            for j in range(i + 1, len(runs)):
                where = np.minimum(np.searchsorted(strings[i], strings[j]), len(strings[i]) - 1)
                hit = np.flatnonzero(strings[i][where] == strings[j])
                both = np.minimum(runs[i][2][where[hit]], runs[j][2][hit])
                runs[i][2][where[hit]], runs[j][2][hit] = both, both
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate([r[3] for r in runs]), np.concatenate([r[2][r[4]] for r in runs])


def _six(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def _from_six(b: bytes) -> np.ndarray:
    out = np.zeros((len(b) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(b, np.uint8).reshape(-1, 6)
    return out.view(np.uint64)[:, 0]


def _narrow(x: np.ndarray) -> bytes:
    """Whole numbers as their least and the distances from it, in as few bytes as the largest needs."""
    least = int(x.min())
    away = (x - least).view(np.uint64)
    kind = next(k for k in (np.uint8, np.uint16, np.uint32, np.uint64) if int(away.max()) <= np.iinfo(k).max)
    return np.int64(least).tobytes() + away.astype(kind).tobytes()


def _from_narrow(b: bytes, n: int) -> np.ndarray:
    away = np.frombuffer(b, np.dtype(f"u{(len(b) - 8) // n}"), offset=8).astype(np.uint64)
    return away.view(np.int64) + np.frombuffer(b[:8], np.int64)[0]


ANSWER = "shard long, bucket int, part string, place binary, code binary"


def _answer_rows(shard: np.ndarray, place: np.ndarray, code: np.ndarray, bucket: int, part: str) -> pa.Table:
    order = np.argsort(shard, kind="stable")
    names, first = np.unique(shard[order], return_index=True)
    groups = np.split(order, first[1:]) if len(names) else []
    return pa.table(
        {
            "shard": pa.array(names, pa.int64()),
            "bucket": pa.array([bucket] * len(names), pa.int32()),
            "part": pa.array([part] * len(names), pa.string()),
            "place": pa.array([place[g].astype(np.uint32).tobytes() for g in groups], pa.binary()),
            "code": pa.array([code[g].astype(np.uint32).tobytes() for g in groups], pa.binary()),
        }
    )


def shard_of(shards: int) -> Column:
    """Rows that share a doc_id spread by their texts: nothing needs them together."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards))


def remove_repeats(docs: DataFrame, shard_bytes: int = SHARD_BYTES, bucket_bytes: int = BUCKET_BYTES, many: int = MANY) -> DataFrame:
    """(doc_id, n_bytes, spans array<struct<s, e>>, kept binary) of every row of docs with (doc_id, text)."""
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    total = ready.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards, buckets = max(1, math.ceil(total / shard_bytes)), max(1, math.ceil(total / bucket_bytes))
    small_batches(docs.sparkSession)

    def mark(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = marks([t.encode("utf-8", "surrogatepass") for t in batch.column("text").to_pylist()])
        return pa.record_batch([*batch.columns, pa.array(found, pa.binary())], ["doc_id", "text", "marks"])

    marked = ready.where("doc_id IS NOT NULL").mapInArrow(per_batch(mark), "doc_id long, text string, marks binary")
    dealt = marked.withColumn("shard", shard_of(shards)).repartition(shards, "shard")  # one exchange, reused by the three steps that need texts

    def list_anchors(key: tuple, table: pa.Table) -> pa.Table:
        s = Shard(table)
        order, begin = s.by_bucket(buckets, many)
        rows = [order[a:b] for a, b in zip(begin[:-1], begin[1:])]
        full = [b for b, r in enumerate(rows) if len(r)]
        return pa.table(
            {
                "bucket": pa.array(full, pa.int32()),
                "shard": pa.array([key[0].as_py()] * len(full), pa.int64()),
                "h": pa.array([_six(s.h[rows[b]]) for b in full], pa.binary()),
                "near": pa.array([_six(s.near[rows[b]]) for b in full], pa.binary()),
                "least": pa.array([_narrow(s.least[rows[b]]) for b in full], pa.binary()),
            }
        )

    def meet(key: tuple, table: pa.Table) -> pa.Table:
        h, near, least = (table.column(c).to_pylist() for c in ("h", "near", "least"))
        count = np.array([len(x) // 6 for x in h])
        shard = np.repeat(table.column("shard").to_numpy(), count)
        place = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        least = np.concatenate([_from_narrow(x, n) for x, n in zip(least, count.tolist(), strict=True)])
        h, near = _from_six(b"".join(h)), _from_six(b"".join(near))
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.diff(h[order], prepend=h[order[0]] + np.uint64(1)))
        size = np.diff(np.append(first, len(h)))
        lowest = np.minimum.reduceat(least[order], first)
        equal = np.minimum.reduceat(near[order], first) == np.maximum.reduceat(near[order], first)
        group = np.repeat(np.arange(len(first)), size)
        code = np.where(equal[group], np.where(least[order] > lowest[group], 2, 0), np.where(size[group] >= many, 3, 1))
        code[size[group] == 1] = 0
        told = np.flatnonzero(code)
        return _answer_rows(shard[order][told], place[order][told], code[told], key[0].as_py(), "met")

    def send_texts(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left)
        entry, code = s.answers(right, buckets, "met", many)
        hot = entry[code == 3]
        order, begin = s.by_bucket(buckets, many)
        place = np.empty(len(s.h), np.int64)
        place[order] = np.arange(len(order)) - np.repeat(begin[:-1], np.diff(begin))
        entry = np.sort(entry[code == 1])
        of = (s.h[entry] % np.uint64(buckets)).astype(np.int64)
        full, rows = np.unique(of).tolist(), []
        data = s.data.tobytes()
        for b in full:
            e = entry[of == b]
            lo, hi = s.lo[s.head[e]], s.hi[s.head[e]] + WINDOW
            rows.append((place[e].astype(np.uint32).tobytes(), s.least[e].tobytes(), (hi - lo).astype(np.uint8).tobytes(), b"".join(data[x:y] for x, y in zip(lo.tolist(), hi.tolist()))))
        if len(hot):
            *_, at, hashed, least = s.windows_of(hot)
            to = (hashed % np.uint64(HOT_SPREAD * buckets)).astype(np.int64) + buckets
            turn = np.argsort(to, kind="stable")
            dealt_to, first = np.unique(to[turn], return_index=True)
            for b, e in zip(dealt_to.tolist(), np.split(turn, first[1:]), strict=True):
                full.append(b)
                rows.append((e.astype(np.uint32).tobytes(), least[e].tobytes(), np.full(len(e), WINDOW, np.uint8).tobytes(), b"".join(data[x : x + WINDOW] for x in at[e].tolist())))
        names = ("place", "least", "size", "text")
        return pa.table(
            {"bucket": pa.array(full, pa.int32()), "shard": pa.array([key[0].as_py()] * len(full), pa.int64())}
            | {n: pa.array([r[i] for r in rows], pa.binary()) for i, n in enumerate(names)}
        )

    def sort_texts(key: tuple, table: pa.Table) -> pa.Table:
        cols = {c: table.column(c).to_pylist() for c in ("place", "least", "size", "text")}
        shard = np.repeat(table.column("shard").to_numpy(), [len(x) // 4 for x in cols["place"]])
        place, least = np.frombuffer(b"".join(cols["place"]), np.uint32), np.frombuffer(b"".join(cols["least"]), np.int64)
        size = np.frombuffer(b"".join(cols["size"]), np.uint8).astype(np.int64)
        end, data = np.cumsum(size), b"".join(cols["text"])
        texts = [data[a:b] for a, b in zip((end - size).tolist(), end.tolist())]
        whose, lowest = smallest_holders(texts, least)
        windows = size - WINDOW + 1
        bit = np.arange(len(whose)) - np.repeat(np.cumsum(windows) - windows, windows)
        mask = np.zeros(len(size), np.uint32)
        np.bitwise_or.at(mask, whose, np.where(lowest < least[whose], np.left_shift(1, bit), 0).astype(np.uint32))
        told = np.flatnonzero(mask)
        return _answer_rows(shard[told], place[told], mask[told], key[0].as_py(), "sorted" if key[0].as_py() < buckets else "hot")

    def apply_answers(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        s = Shard(left)
        mask = np.zeros(len(s.h), np.uint32)
        entry, code = s.answers(right, buckets, "met", many)
        mask[entry[code == 2]] = 0xFFFFFFFF
        hot = entry[code == 3]
        entry, code = s.answers(right, buckets, "sorted", many)
        mask[entry] |= code
        if len(hot):
            owner, bit, number, at, _, least = s.windows_of(hot)
            lower = np.zeros(len(at), bool)
            for part, where in zip(right.column("part").to_pylist(), right.column("place").to_pylist(), strict=True):
                if part == "hot":
                    lower[np.frombuffer(where, np.uint32)] = True
            hit = np.flatnonzero(lower[number] | (s.least[owner] > least[number]))
            np.bitwise_or.at(mask, owner[hit], np.left_shift(1, bit[hit]).astype(np.uint32))
        mine = mask[s.entry]
        mine[s.number[s.doc] > s.least[s.entry]] = 0xFFFFFFFF
        cover = np.zeros(len(s.data) + WINDOW + 1, np.int32)
        whole, part = np.flatnonzero(mine == 0xFFFFFFFF), np.flatnonzero((mine != 0xFFFFFFFF) & (mine != 0))
        np.add.at(cover, s.lo[whole], 1)
        np.add.at(cover, s.hi[whole] + WINDOW, -1)
        for bit in range(PER):
            hit = part[(mine[part] >> np.uint32(bit) & np.uint32(1)).astype(bool) & (s.lo[part] + bit <= s.hi[part])]
            np.add.at(cover, s.lo[hit] + bit, 1)
            np.add.at(cover, s.lo[hit] + bit + WINDOW, -1)
        gone = np.cumsum(cover)[: len(s.data)] > 0
        spans, kept = [], []
        for a, b in zip(s.start.tolist(), s.end.tolist()):
            g = gone[a:b]
            if g.any():
                edge = np.flatnonzero(np.diff(np.concatenate([[False], g, [False]]).astype(np.int8)))
                spans.append([{"s": int(x), "e": int(y)} for x, y in zip(edge[::2], edge[1::2])])
                kept.append(s.data[a:b][~g].tobytes())
            else:
                spans.append([])
                kept.append(s.data[a:b].tobytes())
        kind = pa.list_(pa.struct([("s", pa.int64()), ("e", pa.int64())]))
        return pa.table({"doc_id": pa.array(s.ids, pa.int64()), "n_bytes": pa.array(s.end - s.start), "spans": pa.array(spans, kind), "kept": pa.array(kept, pa.binary())})

    listed = dealt.groupBy("shard").applyInArrow(list_anchors, "bucket int, shard long, h binary, near binary, least binary")
    met = stage(listed.groupBy("bucket").applyInArrow(meet, ANSWER), "met-anchors")  # two steps read it
    texts = dealt.groupBy("shard").cogroup(met.groupBy("shard")).applyInArrow(send_texts, "bucket int, shard long, place binary, least binary, size binary, text binary")
    ordered = texts.groupBy("bucket").applyInArrow(sort_texts, ANSWER)
    answers = met.unionByName(ordered)
    spans = "array<struct<s:long,e:long>>"
    found = dealt.groupBy("shard").cogroup(answers.groupBy("shard")).applyInArrow(apply_answers, f"doc_id long, n_bytes long, spans {spans}, kept binary")
    unnamed = ready.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast(spans).alias("spans"), F.col("text").cast("binary").alias("kept"))
    return found.unionByName(unnamed)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["e"] - x["s"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )
