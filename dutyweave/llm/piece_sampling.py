"""Sampled SentencePiece segmentation by forward filtering and backward sampling.

A text is a lattice of vocabulary pieces. Forward filtering gives every position the
log of the total weight of all ways to reach it; backward sampling draws the pieces
from the end. Draws come from a counter-based generator keyed by the row's key, the
unit and the step, so a row gets the same segmentation on every run, in every batch.

No piece of the vocabulary holds a word mark after another character, so the lattice
falls apart at word starts (and around characters that no longer piece holds); those
units are independent and are drawn for a whole batch at once in numpy. Units of more
than LONG_UNIT characters (scripts without blanks, long identifiers) are drawn one by
one: their forward pass keeps one number a character, and the pieces that end in a block
of characters are found again where sampling comes back to it. Texts of more than
CHUNK_CHARS characters are taken in parts that end where a unit does. A character outside the vocabulary is
written as its UTF-8 bytes' pieces, and so is a word mark that stands in the text
itself, which keeps decoding lossless.

Defined results for odd input: a null text has null pieces, an empty text none; a
null doc_id is one fixed key; repeated rows get equal pieces; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyweave.llm.batches import per_batch, small_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
LONG_UNIT = 256
#: Characters of a long unit whose pieces are held at once.
BLOCK = 1 << 14
MARK = 0x2581
#: Stands for a word mark that the text itself holds.
LITERAL_MARK = 0x110000
#: Characters of texts handled at once; memory of a task grows with their lattices.
CHUNK_CHARS = 1 << 18
MIX = np.uint64(0x9E3779B97F4A7C15)
ODD = np.uint64(0xD1342543DE82EF95)


@dataclass
class Vocabulary:
    """Trie nodes by the hash of their prefix, each with a piece or -1; piece weights; bytes of each piece."""

    node_hash: np.ndarray
    node_piece: np.ndarray
    weight: np.ndarray
    longest: int
    joined: np.ndarray
    byte_piece: np.ndarray
    piece_start: np.ndarray
    piece_size: np.ndarray
    piece_bytes: np.ndarray


def splitmix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x + MIX).astype(np.uint64)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _powers(n: int) -> np.ndarray:
    out = np.full(n + 1, ODD, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def load_vocabulary(model: str = MODEL) -> Vocabulary:
    """Reads the model on the driver; the arrays travel to the tasks."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    size = sp.get_piece_size()
    weight, texts, byte_piece = np.zeros(size), [b""] * size, np.zeros(256, np.int32)
    nodes: dict[tuple[int, ...], int] = {}
    inside: set[int] = set()
    longest = 1
    for i in range(size):
        if sp.is_control(i) or sp.is_unknown(i):
            continue
        piece = sp.id_to_piece(i)
        if sp.is_byte(i):
            byte_piece[int(piece[1:-1], 16)] = i
            texts[i] = bytes([int(piece[1:-1], 16)])
            continue
        cps = tuple(map(ord, piece))
        if any(b == MARK and a != MARK for a, b in zip(cps, cps[1:])):
            raise ValueError(f"piece {piece!r} crosses a word start, where texts are split")
        weight[i] = -np.log(10 - sp.get_score(i))
        texts[i] = piece.replace("▁", " ").encode()
        for n in range(1, len(cps)):
            nodes.setdefault(cps[:n], -1)
        nodes[cps] = i
        longest = max(longest, len(cps))
        if len(cps) > 1:
            inside.update(cps)
    power = _powers(longest)
    keys = np.empty(len(nodes), np.uint64)
    with np.errstate(over="ignore"):
        for k, cps in enumerate(nodes):
            keys[k] = (splitmix(np.array(cps, np.uint64)) * power[len(cps) - 1 :: -1][: len(cps)]).sum(dtype=np.uint64)
    order = np.argsort(keys)
    if len(np.unique(keys)) != len(keys):
        raise ValueError("two prefixes of the vocabulary share a hash")
    sizes = np.array([len(t) for t in texts], np.int64)
    return Vocabulary(
        keys[order], np.array(list(nodes.values()), np.int32)[order], weight.astype(np.float32), longest, np.array(sorted(inside), np.int64), byte_piece,
        np.cumsum(sizes) - sizes, sizes, np.frombuffer(b"".join(texts), np.uint8),
    )


def _units(cps: np.ndarray, doc_of: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """Start positions of the units of the concatenated, marked texts."""
    first = np.empty(len(cps), bool)
    first[0] = True
    new_doc = doc_of[1:] != doc_of[:-1]
    at = np.searchsorted(vocab.joined, cps)
    lone = vocab.joined[np.minimum(at, len(vocab.joined) - 1)] != cps
    first[1:] = new_doc | ((cps[1:] == MARK) & (cps[:-1] != MARK)) | lone[1:] | lone[:-1]
    return np.flatnonzero(first)


def _pieces(cps: np.ndarray, room: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    """By end position and length less 1, the piece of these characters (-2: the bytes of one, -1: none); room: characters left in the unit from each start."""
    n, with_hash = len(cps), splitmix(cps.astype(np.uint64))
    piece = np.full((n, vocab.longest), -1, np.int32)
    alive, h = np.arange(n), np.zeros(n, np.uint64)
    for length in range(1, vocab.longest + 1):
        with np.errstate(over="ignore"):
            h = h * ODD + with_hash[alive + length - 1]
        at = np.minimum(np.searchsorted(vocab.node_hash, h), len(vocab.node_hash) - 1)
        known = vocab.node_hash[at] == h
        found = vocab.node_piece[at]
        if length == 1:
            found = np.where(known & (found >= 0), found, -2)
        else:
            found = np.where(known, found, -1)
        piece[alive + length - 1, length - 1] = found
        go = known & (room[alive] > length)
        alive, h = alive[go], h[go]
        if not len(alive):
            return np.ascontiguousarray(piece[:, :length])
    return piece


def _weights(piece: np.ndarray, vocab: Vocabulary) -> np.ndarray:
    return np.where(piece >= 0, vocab.weight[np.maximum(piece, 0)], np.where(piece == -2, np.float32(-60), np.float32(-np.inf)))


def draw_long(cps: np.ndarray, vocab: Vocabulary, stream: np.uint64) -> tuple[np.ndarray, np.ndarray]:
    """Pieces of one long unit in order, and the position at which each ends. Holds 8 bytes a character and the pieces of one block."""
    n = len(cps)

    def block(a: int) -> tuple[np.ndarray, np.ndarray]:
        b, c = min(n, a + BLOCK), max(0, a - vocab.longest + 1)
        piece = _pieces(cps[c:b], np.arange(b - c, 0, -1), vocab)[a - c :]
        return piece, _weights(piece, vocab).astype(np.float64)

    alpha = np.zeros(n + 1)
    for a in range(0, n, BLOCK):
        weight = block(a)[1]
        for i in range(len(weight)):
            e = a + i + 1
            s = alpha[max(0, e - weight.shape[1]) : e][::-1] + weight[i, : min(e, weight.shape[1])]
            top = s.max()
            alpha[e] = top + np.log(np.exp(s - top).sum())
    ids, ends, e, step, held = [], [], n, 0, -1
    while e:
        if (a := (e - 1) // BLOCK * BLOCK) != held:
            (piece, weight), held = block(a), a
        s = alpha[max(0, e - weight.shape[1]) : e][::-1] + weight[e - 1 - a, : min(e, weight.shape[1])]
        cum = np.cumsum(np.exp(s - alpha[e]))
        with np.errstate(over="ignore"):
            r = float(splitmix(stream + np.uint64(step) * ODD) >> np.uint64(11)) / 2.0**53
        possible = np.flatnonzero(piece[e - 1 - a, : len(s)] != -1)
        take = int(possible[min(np.searchsorted(cum[possible] / cum[-1], r, "right"), len(possible) - 1)])
        ids.append(piece[e - 1 - a, take])
        ends.append(e - 1)
        e -= take + 1
        step += 1
    return np.array(ids[::-1], np.int32), np.array(ends[::-1], np.int64)


def _lattice(cps: np.ndarray, start: np.ndarray, size: np.ndarray, vocab: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """For units of concatenated characters: by end position and length, cumulative draw probability and piece (-2: bytes)."""
    n = len(cps)
    offset = np.arange(n) - np.repeat(start, size)
    piece = _pieces(cps, np.repeat(size, size) - offset, vocab)
    wide = piece.shape[1]
    weight = _weights(piece, vocab)
    alpha = np.full(n, -np.inf, np.float32)
    by_offset = np.argsort(offset, kind="stable")
    bounds = np.append(np.flatnonzero(np.diff(offset[by_offset], prepend=-1)), n)
    span = np.arange(wide)
    score = np.empty((n, wide), np.float32)
    for i in range(len(bounds) - 1):
        at = by_offset[bounds[i] : bounds[i + 1]]
        width = min(i + 1, wide)
        before = at[:, None] - span[None, :width] - 1
        came = alpha[np.maximum(before, 0)]
        if width == i + 1:
            came[:, -1] = 0.0
        s = came + weight[at, :width]
        top = s.max(1)
        e = np.exp(s - top[:, None])
        total = e.sum(1)
        alpha[at] = top + np.log(total)
        score[at, :width] = np.cumsum(e, 1) / total[:, None]
        score[at, width:] = 2.0
    return score, piece


def encode_batch(texts: list[str | None], keys: np.ndarray, vocab: Vocabulary, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(sizes by text, piece ids of all texts)."""
    sizes, parts, i = np.zeros(len(texts), np.int64), [], 0
    while i < len(texts):
        if len(texts[i] or "") > CHUNK_CHARS:
            ids = _encode_long_text(texts[i], keys[i : i + 1], vocab, seed)
            sizes[i] = len(ids)
            parts.append(ids)
            i += 1
            continue
        j, chars = i, 0
        while j < len(texts) and chars + len(texts[j] or "") <= CHUNK_CHARS:
            chars += len(texts[j] or "")
            j += 1
        live = [k for k in range(i, j) if texts[k]]
        if live:
            cps, doc_of = _marked([texts[k] for k in live])
            n, ids = _encode_units(cps, doc_of, _units(cps, doc_of, vocab), np.zeros(len(live), np.int64), keys[live], vocab, seed)
            sizes[live] = n
            parts.append(ids)
        i = j
    return sizes, np.concatenate(parts) if parts else np.zeros(0, np.int32)


def _encode_long_text(text: str, key: np.ndarray, vocab: Vocabulary, seed: int) -> np.ndarray:
    """Part by part, each of whole units; at least one unit a part."""
    cps, doc_of = _marked([text])
    start = _units(cps, doc_of, vocab)
    bounds, u, parts = np.append(start, len(cps)), 0, []
    while u < len(start):
        v = max(u + 1, int(np.searchsorted(bounds, bounds[u] + CHUNK_CHARS, "right")) - 1)
        part = slice(bounds[u], bounds[v])
        parts.append(_encode_units(cps[part], doc_of[part], start[u:v] - bounds[u], np.array([u]), key, vocab, seed)[1])
        u = v
    return np.concatenate(parts)


def _marked(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Characters of the texts, a word mark before each, and the text each belongs to."""
    body = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    length = np.array([len(t) for t in texts], np.int64)
    body = np.where(body == MARK, LITERAL_MARK, np.where(body == 32, MARK, body))
    cps = np.full(len(body) + len(texts), MARK, np.int64)
    cps[np.arange(len(body)) + np.repeat(np.arange(len(texts)), length) + 1] = body
    return cps, np.repeat(np.arange(len(texts)), length + 1)


def _encode_units(cps: np.ndarray, doc_of: np.ndarray, start: np.ndarray, before: np.ndarray, keys: np.ndarray, vocab: Vocabulary, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(sizes by text, piece ids) of units that begin at start; before: units of each text in earlier parts."""
    size = np.diff(np.append(start, len(cps)))
    unit_doc = doc_of[start]
    nth = np.arange(len(start)) - np.repeat(np.flatnonzero(np.diff(unit_doc, prepend=-1)), np.bincount(unit_doc, minlength=len(keys))) + before[unit_doc]
    with np.errstate(over="ignore"):
        stream = splitmix(splitmix(keys.astype(np.uint64) + np.uint64(seed) * MIX)[unit_doc] + nth.astype(np.uint64))
    short = np.flatnonzero(size <= LONG_UNIT)
    count, drawn = np.zeros(len(start), np.int64), []
    if len(short):
        drawn = _draw_short(cps, start[short], size[short], stream[short], vocab)
        for a, _, _ in drawn:
            count[short[a]] += 1
    long = {int(u): draw_long(cps[start[u] : start[u] + size[u]], vocab, stream[u]) for u in np.flatnonzero(size > LONG_UNIT)}
    for u, (ids, _) in long.items():
        count[u] = len(ids)
    end = np.cumsum(count)
    ids, where = np.empty(int(end[-1]), np.int32), np.empty(int(end[-1]), np.int64)
    for k, (a, p, at) in enumerate(drawn):
        ids[end[short[a]] - 1 - k], where[end[short[a]] - 1 - k] = p, at
    for u, (p, at) in long.items():
        ids[end[u] - count[u] : end[u]], where[end[u] - count[u] : end[u]] = p, start[u] + at
    owner = np.repeat(unit_doc, count)
    lone = np.flatnonzero(ids == -2)
    if len(lone):
        cp, back = np.unique(cps[where[lone]], return_inverse=True)
        coded = [("▁" if c == LITERAL_MARK else chr(c)).encode("utf-8", "surrogatepass") for c in cp]
        wide = np.ones(len(ids), np.int64)
        wide[lone] = np.array([len(c) for c in coded])[back]
        at = np.cumsum(wide) - wide
        out = np.repeat(ids, wide)
        for k, c in enumerate(coded):
            for b, byte in enumerate(c):
                out[at[lone[back == k]] + b] = vocab.byte_piece[byte]
        ids, owner = out, np.repeat(owner, wide)
    return np.bincount(owner, minlength=len(keys)), ids


def _draw_short(cps: np.ndarray, start: np.ndarray, size: np.ndarray, stream: np.ndarray, vocab: Vocabulary) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """By step from the units' ends: units still active, the piece drawn for each, the position at which it ends."""
    own = np.repeat(start - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
    with np.errstate(over="ignore"):
        each = splitmix(cps[own].astype(np.uint64))
        own -= np.repeat(start, size)
        each *= _powers(LONG_UNIT)[own]
        name = splitmix(np.add.reduceat(each, np.cumsum(size) - size) + size.astype(np.uint64))
    del own, each  # before the lattice, where memory peaks
    _, sample, unit_of = np.unique(name, return_index=True, return_inverse=True)
    u_size = size[sample]
    u_start = np.cumsum(u_size) - u_size
    flat = np.repeat(start[sample] - u_start, u_size) + np.arange(int(u_size.sum()))
    score, piece = _lattice(cps[flat], u_start, u_size, vocab)
    active, left, step, drawn = np.arange(len(start)), size.copy(), 0, []
    while len(active):
        at = u_start[unit_of[active]] + left[active] - 1
        with np.errstate(over="ignore"):
            r = (splitmix(stream[active] + np.uint64(step) * ODD) >> np.uint64(11)).astype(np.float64) / 2.0**53
        cum = score[at]
        take = (cum <= r[:, None]).sum(1)
        bad = piece[at, np.minimum(take, piece.shape[1] - 1)] == -1  # rounding at the end of the row
        if bad.any():
            take[bad] = [np.flatnonzero(piece[k] != -1)[-1] for k in at[bad]]
        drawn.append((active, piece[at, take], start[active] + left[active] - 1))
        left[active] -= take + 1
        active = active[left[active] > 0]
        step += 1
    return drawn


def decode_batch(sizes: np.ndarray, ids: np.ndarray, vocab: Vocabulary) -> list[bytes]:
    """UTF-8 of each text: its pieces' bytes without the leading blank that encoding adds."""
    wide = vocab.piece_size[ids]
    data = vocab.piece_bytes[np.repeat(vocab.piece_start[ids] - (np.cumsum(wide) - wide), wide) + np.arange(int(wide.sum()))].tobytes()
    at = np.append(0, np.cumsum(wide))[np.append(0, np.cumsum(sizes))]
    return [data[a + (b > a) : b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]


def encode(docs: DataFrame, vocab: Vocabulary, seed: int = 0) -> DataFrame:
    """(doc_id, n_pieces, piece_ids, lossless) for every row of docs; lossless: decoding gives the text back."""
    small_batches(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts, doc_ids = batch.column("text").to_pylist(), batch.column("doc_id")
        keys = doc_ids.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        sizes, ids = encode_batch(texts, keys, vocab, seed)
        back = decode_batch(sizes, ids, vocab)
        same = [t is None or t.encode("utf-8", "surrogatepass") == b for t, b in zip(texts, back, strict=True)]
        ends = np.append(0, np.cumsum(sizes)).astype(np.int32)
        offsets = pa.array([None if t is None else int(e) for t, e in zip(texts, ends)] + [int(ends[-1])], pa.int32())
        pieces = pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32()))
        return pa.record_batch([doc_ids, pa.array(sizes), pieces, pa.array(same)], ["doc_id", "n_pieces", "piece_ids", "lossless"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(per_batch(run), "doc_id long, n_pieces long, piece_ids array<int>, lossless boolean")


def decode(encoded: DataFrame, vocab: Vocabulary) -> DataFrame:
    """(doc_id, text) of rows with (doc_id, piece_ids)."""
    small_batches(encoded.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = batch.column("piece_ids").to_pylist()
        sizes = np.array([len(r or ()) for r in rows], np.int64)
        ids = np.array([x for r in rows if r for x in r], np.int64)
        texts = [None if r is None else b.decode("utf-8", "replace") for r, b in zip(rows, decode_batch(sizes, ids, vocab), strict=True)]
        return pa.record_batch([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "piece_ids").mapInArrow(per_batch(run), "doc_id long, text string")


def op10_piece_sampling(spark: SparkSession, sf_dir: str, model: str = MODEL) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/documents.parquet"), load_vocabulary(model))
