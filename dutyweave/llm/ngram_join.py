"""Exact Jaccard self-join of documents on word shingles, size-aware (light and heavy sets).

A document is the set of its distinct word shingles, by 64-bit hash. Equal sets are
one class with one representative. Tokens have one global order: rare ones by hash,
then those held by more than HOT_SHARE of a batch's documents, commonest last and
equally common ones by hash.

Two sets with Jaccard similarity t overlap in at least ceil(t * larger) tokens, so
the first n - ceil(t n) + h tokens of both share at least h. Light (small) sets
enumerate the 2-subsets of that prefix for h = 2; heavy sets enter the inverted lists
of its single tokens for h = 1; sets close below the boundary do both. The boundary
minimises the modelled cost over the counted sizes.

Sets that share a list or subset become neighbours if sizes and histograms of hashes
allow the similarity (the histograms' distance never exceeds the symmetric
difference, so no link is lost). Components of these neighbours are candidate groups;
a group's sets meet once and all its links are verified exactly by scanning the
group's inverted lists. Only links that join two parts of a block leave a task.

Lists beyond LONG_LIST sets and groups beyond BLOCK_TOKENS are split into blocks, so no
task holds an unbounded one. First each block meets block zero alone, which joins a
family of near copies at a cost linear in its size. What is in one part then needs no
further comparison: where several parts are left, the sets outside the largest part
are dealt into blocks of their own, which meet each other and the largest part's
blocks. No link between two parts is lost.

Defined results for odd input: null and empty texts have no shingles and link with
nothing; a text with fewer words than a shingle is one shingle of all its words; very
long texts are hashed whole; rows that share a doc_id are linked only if their texts are;
a null doc_id links with nothing and has a null component; an empty table gives an empty
result; other columns are ignored. A similarity of a half or less is refused: sets that
share one token of two would have no signature in common.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.llm.batches import per_batch, small_batches
from dutyweave.llm.components import connected_components
from dutyweave.llm.piece_sampling import splitmix
from dutyweave.staging import stage

WORDS = 5
PERCENT = 80
HOT_SHARE = 0.002
MAX_HOT = 1 << 20
#: Cost of an inverted-list entry against that of an enumerated subset.
LIST_COST = 4.0
#: Lists longer than this are split into blocks.
LONG_LIST = 2048
BLOCK_TOKENS = 1 << 19
PIECE = 1 << 22
ODD = np.uint64(0xD1342543DE82EF95)
ODD_INVERSE = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
SALT = np.uint64(0xA0761D6478BD642F)
MAX_WORDS = 64
#: Independent odd factors of a shingle's words.
FACTORS = splitmix(np.arange(MAX_WORDS, dtype=np.uint64)) | np.uint64(1)


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the words of one byte buffer, A-Z lower-cased."""
    data = np.where((data >= 65) & (data <= 90), data + 32, data)
    solid = ~((data == 32) | ((data >= 9) & (data <= 13)))
    edge = np.diff(np.concatenate([[False], solid, [False]]).astype(np.int8))
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return start, np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.concatenate([[np.uint64(0)], np.cumsum(splitmix(np.arange(256, dtype=np.uint64))[data] * _powers(ODD, len(data))[: len(data)], dtype=np.uint64)])
        h = (total[end] - total[start]) * _powers(ODD_INVERSE, len(data))[start]
        return start, splitmix(h ^ (end - start).astype(np.uint64) * SALT)


def shingle_sets(texts: list[str | None], words: int) -> Iterator[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    i = 0
    while i < len(texts):
        raw, size, j = [], 0, i
        while j < len(texts) and (j == i or size < PIECE):
            raw.append((texts[j] or "").encode("utf-8", "replace"))
            size += len(raw[-1]) + 1
            j += 1
        start, h = word_hashes(np.frombuffer(b" ".join(raw), np.uint8))
        first = np.searchsorted(start, np.cumsum([0] + [len(r) + 1 for r in raw]))
        with np.errstate(over="ignore"):
            mixed = np.zeros(len(h), np.uint64)
            for k in range(words):
                mixed[: len(h) - k] += np.roll(h, -k)[: len(h) - k] * FACTORS[k]
            mixed = splitmix(mixed)
        for a, b in zip(first[:-1].tolist(), first[1:].tolist()):
            if b - a >= words:
                yield np.unique(mixed[a : b - words + 1])
            elif b > a:
                with np.errstate(over="ignore"):
                    part = (h[a:b] * FACTORS[: b - a]).sum(dtype=np.uint64)
                yield splitmix(np.array([part + np.uint64(b - a)]))
            else:
                yield h[:0]
        i = j


def least_overlap(n: int | np.ndarray, percent: int) -> int | np.ndarray:
    return -(-n * percent // 100)


def signature_count(n: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Of sets of n tokens: list entries, enumerated subsets."""
    p = n - least_overlap(n, percent) + 1
    return p, np.where(n > 1, p * (p + 1) // 2, 0)


def choose_boundary(sizes: dict[int, int], percent: int) -> int:
    """The largest light size, by modelled cost; sets within the similarity below it pay for both kinds."""
    n = np.array(sorted(s for s in sizes if s > 0), np.int64)
    if not len(n):
        return 0
    count = np.array([sizes[int(s)] for s in n], float)
    lists, subsets = signature_count(n, percent)
    best, boundary = np.inf, 0
    for b in [0, *range(2, 201)]:
        cost = (count * (np.where(n <= b, subsets, 0) + np.where(n * 100 >= percent * b, LIST_COST * lists, 0))).sum()
        if cost < best:
            best, boundary = cost, b
    return boundary


def signatures(s: np.ndarray, hot: np.ndarray, hot_rank: np.ndarray, boundary: int, percent: int) -> np.ndarray:
    """Hashes of the lists and subsets that a set enters."""
    n = len(s)
    if n < 2:
        return s[:0]
    order = s
    if len(hot):
        at = np.minimum(np.searchsorted(hot, s), len(hot) - 1)
        is_hot = hot[at] == s
        order = np.concatenate([s[~is_hot], s[is_hot][np.argsort(hot_rank[at[is_hot]], kind="stable")]])
    p = n - int(least_overlap(n, percent)) + 1
    found = []
    if n > boundary or n * 100 >= percent * boundary:
        found.append(splitmix(order[:p]))
    if n <= boundary:
        head = order[: p + 1]
        i, j = np.triu_indices(len(head), 1)
        with np.errstate(over="ignore"):
            found.append(splitmix((splitmix(np.minimum(head[i], head[j])) + SALT) * ODD + np.maximum(head[i], head[j])))
    return np.concatenate(found)


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """(doc_id, said, n, d1, d2, cells, frequent) of every row; the first row of a batch carries its frequent tokens."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        n, d1, d2, cells, sets = [], [], [], [], []
        for s in shingle_sets(batch.column("text").to_pylist(), words):
            n.append(len(s))
            a, b = digest(s)
            d1.append(a)
            d2.append(b)
            cells.append(cells_of(s))
            sets.append(s)
        token, count = np.unique(np.concatenate(sets), return_counts=True)
        often = count >= max(2, HOT_SHARE * len(sets))
        frequent = [{"h": int(h), "n": int(c)} for h, c in zip(token[often].view(np.int64), count[often])]
        kind = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))
        return pa.record_batch(
            [batch.column("doc_id"), batch.column("said"), pa.array(n, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), pa.array(cells, pa.binary()), pa.array([frequent] + [[]] * (len(n) - 1), kind)],
            ["doc_id", "said", "n", "d1", "d2", "cells", "frequent"],
        )

    return docs.mapInArrow(per_batch(run), "doc_id long, said long, n long, d1 long, d2 long, cells binary, frequent array<struct<h:long,n:long>>")


def digest(s: np.ndarray) -> tuple[int, int]:
    """Two 64-bit sums that name a set."""
    with np.errstate(over="ignore"):
        return int(s.sum(dtype=np.uint64).astype(np.int64)), int(splitmix(s ^ SALT).sum(dtype=np.uint64).astype(np.int64))


def _hot_tokens(profile: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens frequent in the corpus, sorted, with their counts; at most (mean set size) / HOT_SHARE can be."""
    counted = profile.select(F.explode("frequent").alias("f")).groupBy("f.h").agg(F.sum("f.n").alias("n"))
    found = counted.where(F.col("n") >= max(64, HOT_SHARE * rows)).orderBy(F.desc("n"), "h").limit(MAX_HOT).toPandas()
    hot, count = found["h"].to_numpy(np.int64).view(np.uint64), found["n"].to_numpy(np.int64)
    by = np.argsort(hot)
    return hot[by], count[by]


def _signatures(docs: DataFrame, profile: DataFrame, words: int, percent: int) -> DataFrame:
    """(h, node, hot): lists and subsets that each distinct set enters; node names the set. Copies in one batch enter once."""
    sizes = {r["n"]: r["count"] for r in profile.groupBy("n").count().collect()}  # one row a distinct size
    hot, rank = _hot_tokens(profile, sum(sizes.values()))
    boundary = choose_boundary(sizes, percent)
    shared = docs.sparkSession.sparkContext.broadcast((hot, rank, np.sort(splitmix(hot))))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        hot, rank, hot_lists = shared.value
        done, h, node = set(), [], []
        for s in shingle_sets(batch.column("text").to_pylist(), words):
            name = digest(s)
            if name not in done:
                done.add(name)
                h.append(signatures(s, hot, rank, boundary, percent))
                node.append(np.full(len(h[-1]), name[0], np.int64))
        h, node = np.concatenate(h), np.concatenate(node)
        at = np.minimum(np.searchsorted(hot_lists, h), max(0, len(hot_lists) - 1))
        is_hot = hot_lists[at] == h if len(hot_lists) else np.zeros(len(h), bool)
        return pa.record_batch([pa.array(h.view(np.int64)), pa.array(node), pa.array(is_hot)], ["h", "node", "hot"])

    return docs.where("doc_id IS NOT NULL").select("text").mapInArrow(per_batch(run), "h long, node long, hot boolean")


def _root(parent: np.ndarray, i: int) -> int:
    while parent[i] != i:
        parent[i] = parent[parent[i]]
        i = parent[i]
    return i


def cells_of(s: np.ndarray) -> bytes:
    """Histogram of a set over its hashes' leading bits; more cells for large sets, so that chance differences outgrow the bound."""
    bits = min(13, max(6, int(len(s) - 1).bit_length() - 3)) if len(s) else 6
    return np.minimum(np.bincount((s >> np.uint64(64 - bits)).astype(np.int64), minlength=1 << bits), 255).astype(np.uint8).tobytes()


def _matrix(cells: np.ndarray, width: int) -> np.ndarray:
    """Histograms [n, width]; wider ones are folded."""
    return np.stack([np.frombuffer(c, np.uint8).astype(np.int16).reshape(width, -1).sum(1) for c in cells]) if len(cells) else np.zeros((0, width), np.int16)


def _neighbours(percent: int):
    """Over rows sorted by list and size: spanning edges between sets of one list whose sizes and histograms allow a link.

    Saturated cells and folding only lower the histograms' distance.
    """

    def allowed(n: np.ndarray, m: np.ndarray, apart: np.ndarray) -> np.ndarray:
        return (np.minimum(n, m) * 100 >= percent * np.maximum(n, m)) & (apart * (100 + percent) <= (100 - percent) * (n + m))

    def edges(h: np.ndarray, node: np.ndarray, n: np.ndarray, c: np.ndarray) -> Iterator[np.ndarray]:
        new = np.ones(len(h), bool)  # copies in several batches enter a list several times, side by side
        new[1:] = (h[1:] != h[:-1]) | (node[1:] != node[:-1])
        h, node, n, c = h[new], node[new], n[new], c[new]
        start = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
        size = np.diff(np.append(start, len(h)))
        width = np.array([len(x) for x in c], np.int64)
        two = start[size == 2]
        two = two[n[two] * 100 >= percent * n[two + 1]]
        for w in np.unique(width[two]):
            at = two[width[two] == w]
            ok = at[allowed(n[at], n[at + 1], np.abs(_matrix(c[at], w) - _matrix(c[at + 1], w)).sum(1, dtype=np.int64))]
            yield np.stack([node[ok], node[ok + 1]], 1)
        for a, k in zip(start[size > 2].tolist(), size[size > 2].tolist()):
            parent, sizes, wide = np.arange(k), n[a : a + k], width[a : a + k]
            low = np.searchsorted(sizes * 100, sizes * percent)
            begin = {int(w): int(np.searchsorted(wide, w)) for w in np.unique(wide)}
            matrix = {w: _matrix(c[a + f : a + int(np.searchsorted(wide, w, "right"))], w) for w, f in begin.items()}
            for i in range(1, k):
                for w, f in begin.items():
                    x, y = max(int(low[i]), f), min(i, f + len(matrix[w]))
                    if x >= y or w > wide[i]:
                        continue
                    mine = _matrix(c[a + i : a + i + 1], w)[0]
                    apart = np.abs(matrix[w][x - f : y - f] - mine).sum(1, dtype=np.int64)
                    for j in (x + np.flatnonzero(allowed(sizes[i], sizes[x:y], apart))).tolist():
                        p, q = _root(parent, i), _root(parent, j)
                        if p != q:
                            parent[max(p, q)] = min(p, q)
            roots = np.array([_root(parent, i) for i in range(k)])
            far = np.flatnonzero(roots != np.arange(k))
            yield np.stack([node[a + far], node[a + roots[far]]], 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = np.empty(batch.num_rows, object)
            cells[:] = batch.column("cells").to_pylist()
            part = (*(batch.column(k).to_numpy(zero_copy_only=False) for k in ("h", "node", "n")), cells)
            if held is not None:
                part = tuple(np.concatenate([a, b]) for a, b in zip(held, part, strict=True))
            cut = int(np.flatnonzero(np.concatenate([[True], part[0][1:] != part[0][:-1]]))[-1])
            held = tuple(a[cut:] for a in part)
            if cut:
                yield table(edges(*(a[:cut] for a in part)))
        if held is not None:
            yield table(edges(*held))

    def table(parts: Iterator[np.ndarray]) -> pa.RecordBatch:
        found = [np.zeros((0, 2), np.int64), *parts]
        pairs = np.unique(np.concatenate(found).astype(np.int64), axis=0)
        return pa.record_batch([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

    return run


def verify(sets: list[np.ndarray], side: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) that join parts of these sets, by scanning inverted lists; with two sides only pairs across them count."""
    size = np.array([len(s) for s in sets], np.int64)
    token, of = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(token, kind="stable")
    _, start, count = np.unique(token[order], return_index=True, return_counts=True)
    by_token = of[order]
    place = np.empty(len(token), np.int64)
    place[order] = np.repeat(start, count)
    rank = np.empty(len(token), np.int64)
    rank[order] = np.arange(len(token)) - np.repeat(start, count)
    bounds = np.append(0, np.cumsum(size))
    across, parent, out = len(np.unique(side)) > 1, np.arange(len(sets)), []
    for i in range(1, len(sets)):
        s, r = place[bounds[i] : bounds[i + 1]], rank[bounds[i] : bounds[i + 1]]  # the lists' entries before i
        at = np.repeat(s - (np.cumsum(r) - r), r) + np.arange(int(r.sum()))
        both = np.bincount(by_token[at], minlength=i)[:i]
        linked = np.flatnonzero(both * (100 + percent) >= percent * (size[:i] + size[i]))
        for j in linked.tolist():
            if across and side[i] == side[j]:
                continue
            x, y = _root(parent, i), _root(parent, j)
            if x != y:
                parent[max(x, y)] = min(x, y)
                out.append((i, j))
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pairs[:, 0], pairs[:, 1]


def _block(blocks: Column, *key: str) -> Column:
    return F.pmod(F.xxhash64(*key), blocks).cast("int")


def _meeting(a: Column, b: Column) -> Column:
    return F.struct(F.least(a, b).alias("p"), F.greatest(a, b).alias("q"))


def _first_meetings(mine: Column, blocks: Column) -> Column:
    """Each block meets itself and block zero."""
    every = F.transform(F.sequence(F.lit(0), blocks - 1), lambda m: _meeting(F.lit(0), m))
    return F.when(mine == 0, every).otherwise(F.array(_meeting(F.lit(0), mine), _meeting(mine, mine)))


def _later_meetings(rows: DataFrame, key: str, node: str, weight: str, limit: int) -> DataFrame:
    """Of rows (key, node, mine, blocks, part, weight, ...): those of keys with several parts, with new blocks and meetings.

    One row of totals for each old block of a key, so that a key's rows meet them in many tasks.
    """
    parts = rows.groupBy(key, "part").agg(F.sum(weight).alias("w"), F.max("blocks").alias("blocks"))
    total = parts.groupBy(key).agg(F.sum("w").alias("all"), F.max(F.struct("w", "part")).alias("main"), F.count(F.lit(1)).alias("parts"), F.max("blocks").alias("blocks"))
    total = total.where("parts > 1").select(
        key,
        F.col("main.part").alias("main"),
        F.ceil(F.col("main.w") / limit).cast("int").alias("m"),
        F.ceil((F.col("all") - F.col("main.w")) / limit).cast("int").alias("r"),
        F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("mine"),
    )
    met = rows.drop("blocks").join(total, [key, "mine"])
    is_main = F.col("part") == F.col("main")
    met = met.withColumn("mine", F.when(is_main, _block(F.col("m"), node, key)).otherwise(F.col("m") + _block(F.col("r"), node, key)))
    others = F.transform(F.sequence(F.col("m"), F.col("m") + F.col("r") - 1), lambda o: _meeting(F.col("mine"), o))
    mains = F.transform(F.sequence(F.lit(0), F.col("m") - 1), lambda o: _meeting(o, F.col("mine")))
    return met.withColumn("at", F.when(is_main, others).otherwise(F.concat(mains, others)))


def _stars(found: DataFrame) -> DataFrame:
    """Components (node, component) as edges."""
    return found.where("node <> component").select(F.col("node").alias("a"), F.col("component").alias("b"))


def _with_part(rows: DataFrame, node: str, found: DataFrame) -> DataFrame:
    known = found.select(F.col("node").alias(node), F.col("component").alias("part"))
    return rows.join(known, node, "left").withColumn("part", F.coalesce("part", node))


def _neighbour_edges(entries: DataFrame, percent: int) -> DataFrame:
    """Edges (a, b) of entries (h, node, n, cells, at)."""
    met = entries.withColumn("at", F.explode("at"))
    # a clash only compares more sets
    met = met.select(F.xxhash64("h", "at.p", "at.q").alias("h"), "node", "n", "cells").repartition(F.col("h")).sortWithinPartitions("h", "n", "node")
    return met.mapInArrow(_neighbours(percent), "a long, b long")


def _candidates(entries: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of sets that share entries (h, node, hot, held) and may be linked."""
    hot = entries.where("hot").select("h", "node")
    counted = stage(hot.groupBy("h").agg(F.count(F.lit(1)).alias("held")), "hot-lists")
    lists = entries.where("NOT hot").select("h", "node", "held").unionByName(hot.join(counted, "h"))
    blocks = F.ceil(F.col("held") / LONG_LIST).cast("int")
    lists = lists.join(classes.select(F.col("d1").alias("node"), "n", "cells"), "node").withColumn("blocks", blocks)
    lists = lists.withColumn("mine", _block(F.col("blocks"), "node", "h"))
    # in a list's meeting all its sets are compared, so block zero's meetings hold all the others' own
    first = lists.withColumn("at", F.when(F.col("mine") == 0, _first_meetings(F.col("mine"), F.col("blocks"))).otherwise(F.array(_meeting(F.lit(0), F.col("mine")))))
    found = connected_components(_neighbour_edges(first, percent))
    if counted.where(F.col("held") > LONG_LIST).isEmpty() and entries.where(~F.col("hot") & (F.col("held") > LONG_LIST)).isEmpty():
        return found
    found = stage(found, "first-candidates")
    rows = _with_part(lists.where("blocks > 1").withColumn("weight", F.lit(1)), "node", found)
    later = _neighbour_edges(_later_meetings(rows, "h", "node", "weight", LONG_LIST), percent)
    return connected_components(_stars(found).unionByName(later))


def _links(ready: DataFrame, dealt: DataFrame, words: int, percent: int) -> DataFrame:
    """Verified links (a, b) of dealt classes (node, rep, d1, d2, component, mine, at), whose texts are in ready."""
    of = ["node", "d1", "d2", "component", "mine", "at"]
    # the same plan at every size: texts meet their groups in a shuffle
    with_text = ready.join(dealt.select(F.col("rep").alias("doc_id"), *of).hint("shuffle_merge"), "doc_id")

    def sets(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = list(shingle_sets(batch.column("text").to_pylist(), words))
        own = [digest(x) == d for x, d in zip(found, zip(batch.column("d1").to_pylist(), batch.column("d2").to_pylist()))]  # not another text of that doc_id
        at = pa.array(np.flatnonzero(own))
        return pa.record_batch([batch.column(k).take(at) for k in kept] + [pa.array([found[k].tobytes() for k in at.to_pylist()], pa.binary())], [*kept, "tokens"])

    kept = ["node", "component", "mine", "at"]
    shape = "node long, component long, mine int, at array<struct<p:int,q:int>>, tokens binary"
    member = with_text.select(*of, "text").mapInArrow(per_batch(sets), shape)
    member = member.withColumn("at", F.explode("at")).select("component", "at.p", "at.q", "mine", "node", "tokens")

    def check(table: pa.Table) -> pa.Table:
        ids = table.column("node").to_numpy()
        side = table.column("mine").to_numpy()
        order = np.argsort(ids, kind="stable")
        tokens = table.column("tokens").to_pylist()
        i, j = verify([np.frombuffer(tokens[k], np.uint64) for k in order], side[order], percent)
        return pa.table({"a": ids[order][i], "b": ids[order][j]})

    return member.groupBy("component", "p", "q").applyInArrow(check, "a long, b long")


def _grouped(docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(doc_id, said, n_shingles, part, component_id) of every row of docs with (doc_id, text).

    said: hash of the text; part: a number of the linked rows' group, null for rows without a shingle or a doc_id; component_id:
    the group's smallest doc_id, or the row's own.
    """
    if not 50 < percent <= 100:
        raise ValueError("percent must be above 50 and at most 100")
    small_batches(docs.sparkSession)
    text = F.col("text").cast("string")
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    profile = stage(_profile(ready.withColumn("said", F.xxhash64("text")), words), "shingle-profiles")
    classes = profile.where("n > 0 AND doc_id IS NOT NULL").groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.min("cells").alias("cells"))
    classes = stage(classes.withColumn("class", F.monotonically_increasing_id()), "shingle-classes")
    # list members are named by d1, which may clash; that only widens candidate groups, which are verified
    # lists of hot tokens are spread by set here, so that none is gathered to be counted
    spread = F.when(F.col("hot"), F.xxhash64("h", "node")).otherwise(F.col("h"))
    entries = _signatures(ready, profile, words, percent).withColumn("held", F.count(F.lit(1)).over(Window.partitionBy(spread)))
    entries = stage(entries.where("held > 1 OR hot"), "shared-signatures")
    groups = _candidates(entries, classes, percent)
    known = classes.select(F.col("d1").alias("node"), "d1", "d2", "n", "rep", "class")
    groups = stage(groups.join(known, "node"), "candidate-groups")
    weight = groups.groupBy("component").agg(F.sum("n").alias("tokens"), F.count(F.lit(1)).alias("sets")).where("sets > 1")
    dealt = groups.join(weight, "component").select(F.col("class").alias("node"), "rep", "d1", "d2", "component", "n", F.ceil(F.col("tokens") / BLOCK_TOKENS).cast("int").alias("blocks"))
    dealt = dealt.withColumn("mine", _block(F.col("blocks"), "node", "component"))
    first = _links(ready, dealt.withColumn("at", _first_meetings(F.col("mine"), F.col("blocks"))), words, percent)
    found = stage(connected_components(first), "shingle-components")
    if not weight.where(F.col("tokens") > BLOCK_TOKENS).isEmpty():
        rest = _later_meetings(_with_part(dealt.where("blocks > 1"), "node", found), "component", "node", "n", BLOCK_TOKENS)
        found = stage(connected_components(_stars(found).unionByName(_links(ready, rest, words, percent))), "shingle-components")
    linked = classes.join(found.select(F.col("node").alias("class"), F.col("component").alias("part")), "class")
    smallest = linked.groupBy("part").agg(F.min("rep").alias("least"))
    named = classes.join(linked.select("class", "part").join(smallest, "part"), "class", "left")
    named = named.select("d1", "d2", "n", F.coalesce("part", "class").alias("part"), F.coalesce("least", "rep").alias("least"))
    rows = profile.select("doc_id", "said", "n", "d1", "d2").join(named, ["d1", "d2", "n"], "left")
    own = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return rows.select("doc_id", "said", F.col("n").alias("n_shingles"), F.when(own, F.col("part")).alias("part"), F.when(own, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def similar_groups(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs with (doc_id, text)."""
    return _grouped(docs, words, percent).select("doc_id", "n_shingles", "component_id")


def keep_one_of_each(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of docs that stay, with all their columns: of each group of similar rows the one with the smallest doc_id.

    Where a group has several rows of that doc_id, the one with the smallest text stays; they are combined where they are read.
    Rows that share a doc_id are in one group only if their texts are linked, or if none of them has a word. Rows without a
    doc_id stay.
    """
    groups = stage(_grouped(docs, words, percent).where("doc_id IS NOT NULL"), "similar-groups")
    seen = groups.groupBy("doc_id").agg(F.count(F.lit(1)).alias("rows"), F.min("component_id").alias("least"), F.max(F.col("component_id") == F.col("doc_id")).alias("leads"))
    seen = stage(seen.where("rows > 1 OR doc_id <> least"), "not-alone")
    alone = docs.join(seen.select(F.col("doc_id").alias("_seen")), docs["doc_id"].cast("long") == F.col("_seen"), "left_anti")
    shared = seen.where("rows > 1 AND leads").select("doc_id")
    if shared.isEmpty():
        return alone
    leading = groups.where("component_id = doc_id").join(shared, "doc_id", "left_semi").select(F.col("doc_id").alias("_id"), F.col("said").alias("_said"), "part").distinct()
    text = F.col("text").cast("string")
    packed = docs.select(F.col("doc_id").cast("long").alias("_id"), F.xxhash64(text).alias("_said"), F.coalesce(text, F.lit("")).alias("_text"), F.struct(*docs.columns).alias("_row"))
    one = packed.join(leading, ["_id", "_said"]).groupBy("_id", "part").agg(F.min_by("_row", "_text").alias("_row"))
    return alone.unionByName(one.select(*[F.col("_row")[c].alias(c) for c in docs.columns]))


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"), words=4, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 3], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) AS i FROM w WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c(node, reached) AS (SELECT doc_id, doc_id FROM documents UNION SELECT c.node, e.b FROM c JOIN e ON e.a = c.reached)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id
FROM (SELECT node AS doc_id, min(reached) AS component_id FROM c GROUP BY node) LEFT JOIN n USING (doc_id)
"""
