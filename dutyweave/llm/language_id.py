"""Language identification by a bidirectional gated recurrent network over bytes.

The network is trained in numpy by backpropagation through time on a bounded,
seeded sample of labelled documents, and then labels every byte position of every
text: the text's lower-cased UTF-8 bytes are cut into segments, both directions run
over all segments of a batch at once, and a document's probabilities are the mean of
its positions' softmax outputs.

Gates use x / (1 + |x|) as squashing function, in training as in use.

Defined results for odd input: a null text, or one without any letter, is `und` with
score 0; so is every text when no labelled row may be learnt from; a null doc_id is
neither held out nor learnt from; repeated rows are labelled alike; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyweave.llm.batches import held_out, may_learn, per_batch, seeded_sample, small_batches

SEGMENT = 96
HIDDEN = 8
#: Bound of the training sample: documents of each language, windows of each document.
DOCS_PER_LANGUAGE = 900
WINDOWS_PER_DOC = 2
EPOCHS = 8
MINIBATCH = 128
#: Steps at least; small samples are gone through more often.
LEAST_STEPS = 400
CHUNK = 1024
LETTER = re.compile(r"[^\W\d_]")
#: Label of a class trained on garbled windows, where texts in no learnt language are to be told; no language value is empty.
OTHER = ""
#: Mean probability of OTHER over a text's positions, and SHORT more that speak for a language, from which a text is rejected at the earliest.
REJECT_FROM = 0.6
SHORT = 96


@dataclass
class Network:
    """emb [2, 3H, 257]: input weights by byte, 256 for padding; rec [2, 3H, H]; out [C, 2H]; bias [C]."""

    labels: list[str]
    emb: np.ndarray
    rec: np.ndarray
    out: np.ndarray
    bias: np.ndarray
    #: From this share of OTHER on a text is rejected.
    reject_from: float = REJECT_FROM


def squash(x: np.ndarray) -> np.ndarray:
    return x / (1 + np.abs(x))


def segments(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte segments [n, SEGMENT] padded with 256, the text each belongs to, the bytes each holds."""
    raw = [t.lower().encode("utf-8", "replace") for t in texts]
    sizes = np.array([len(b) for b in raw], np.int64)
    counts = -(-sizes // SEGMENT)
    flat = np.full(int(counts.sum()) * SEGMENT, 256, np.int16)
    starts = (np.cumsum(counts) - counts) * SEGMENT
    data = np.frombuffer(b"".join(raw), np.uint8)
    at = np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(len(data))
    flat[at] = data
    owner = np.repeat(np.arange(len(texts)), counts)
    cells = flat.reshape(-1, SEGMENT)
    return cells, owner, (cells != 256).sum(1)


def run_network(net: Network, cells: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
    """Position logits [T, C, B] of cells [B, T]; with keep, what the backward pass needs."""
    b, t_max = cells.shape
    h = np.zeros((2, HIDDEN, b), np.float32)
    states = np.empty((2, t_max, HIDDEN, b), np.float32)
    trace, cut = [], 2 * HIDDEN
    by_time = np.ascontiguousarray(cells.T)
    x, gate_abs, cand_abs = np.empty((2, 3 * HIDDEN, b), np.float32), np.empty((2, cut, b), np.float32), np.empty((2, HIDDEN, b), np.float32)
    for t in range(t_max):
        np.take(net.emb[0], by_time[t], axis=1, out=x[0], mode="clip")
        np.take(net.emb[1], by_time[t_max - 1 - t], axis=1, out=x[1], mode="clip")
        u = net.rec @ h
        gates = x[:, :cut] + u[:, :cut]
        np.abs(gates, out=gate_abs)
        gate_abs += 1
        gates /= gate_abs
        gates *= 0.5
        gates += 0.5
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        cand = r * u[:, cut:]
        cand += x[:, cut:]
        np.abs(cand, out=cand_abs)
        cand_abs += 1
        cand /= cand_abs
        if keep:
            trace.append((h.copy(), u[:, cut:].copy(), gates.copy(), gate_abs.copy(), cand.copy(), cand_abs.copy()))
        h -= cand
        h *= z
        h += cand
        states[0, t] = h[0]
        states[1, t_max - 1 - t] = h[1]
    logits = net.out[:, :HIDDEN] @ states[0] + net.out[:, HIDDEN:] @ states[1] + net.bias[:, None]
    return logits, [states, trace]


def softmax(logits: np.ndarray) -> np.ndarray:
    p = np.exp(logits - logits.max(1, keepdims=True))
    p /= p.sum(1, keepdims=True)
    return p


def gradients(net: Network, cells: np.ndarray, target: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """Mean cross-entropy over positions and its gradient, by backpropagation through time."""
    logits, (states, trace) = run_network(net, cells, keep=True)
    b, t_max = cells.shape
    p, here = softmax(logits), (cells.T != 256).astype(np.float32)
    n = max(here.sum(), 1)
    loss = -(np.log(p[:, target, np.arange(b)] + 1e-9) * here).sum() / n
    d = p
    d[:, target, np.arange(b)] -= 1
    d *= here[:, None, :] / n
    g = {k: np.zeros_like(getattr(net, k)) for k in ("emb", "rec", "out", "bias")}
    g["out"][:, :HIDDEN] = np.einsum("tcb,thb->ch", d, states[0], optimize=True)
    g["out"][:, HIDDEN:] = np.einsum("tcb,thb->ch", d, states[1], optimize=True)
    g["bias"] = d.sum((0, 2))
    d_states = np.stack([net.out[:, :HIDDEN].T @ d, net.out[:, HIDDEN:].T @ d])
    dh, cut = np.zeros((2, HIDDEN, b), np.float32), 2 * HIDDEN
    one_hot = [np.zeros((b, 257), np.float32) for _ in range(2)]
    rows = np.arange(b)
    for t in range(t_max - 1, -1, -1):
        dh += np.stack([d_states[0, t], d_states[1, t_max - 1 - t]])
        h, un, gates, gate_abs, cand, cand_abs = trace[t]
        z, r = gates[:, :HIDDEN], gates[:, HIDDEN:]
        d_cand = dh * (1 - z) / cand_abs**2
        d_z, d_r = dh * (h - cand), d_cand * un
        d_gates = np.concatenate([d_z, d_r], 1) * 0.5 / gate_abs**2
        d_u = np.concatenate([d_gates, d_cand * r], 1)
        d_x = np.concatenate([d_gates, d_cand], 1)
        g["rec"] += d_u @ h.transpose(0, 2, 1)
        dh = dh * z + net.rec.transpose(0, 2, 1) @ d_u
        for k, at in ((0, t), (1, t_max - 1 - t)):
            one_hot[k][rows, cells[:, at]] = 1
            g["emb"][k] += d_x[k] @ one_hot[k]
            one_hot[k][rows, cells[:, at]] = 0
    return float(loss), g


def train(cells: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = EPOCHS, seed: int = 7) -> Network:
    rng = np.random.default_rng(seed)
    net = Network(
        labels,
        rng.normal(0, 0.5, (2, 3 * HIDDEN, 257)).astype(np.float32),
        rng.normal(0, HIDDEN**-0.5, (2, 3 * HIDDEN, HIDDEN)).astype(np.float32),
        rng.normal(0, 0.3, (len(labels), 2 * HIDDEN)).astype(np.float32),
        np.zeros(len(labels), np.float32),
    )
    moments = {k: (np.zeros_like(getattr(net, k)), np.zeros_like(getattr(net, k))) for k in ("emb", "rec", "out", "bias")}
    each = -(-len(cells) // MINIBATCH)
    epochs = max(epochs, -(-LEAST_STEPS // each))
    step, total = 0, epochs * each
    for _ in range(epochs):
        order = rng.permutation(len(cells))
        for i in range(0, len(order), MINIBATCH):
            take = order[i : i + MINIBATCH]
            _, g = gradients(net, cells[take], target[take])
            step += 1
            rate = 0.03 * (1 - step / (total + 1))
            for k, (m, v) in moments.items():
                m += 0.1 * (g[k] - m)
                v += 0.01 * (g[k] ** 2 - v)
                w = getattr(net, k)
                w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net


def garbled(windows: list[str], seed: int) -> list[str]:
    """Each window with its characters shuffled, and with its letters exchanged by a substitution of their own."""
    rng, out = np.random.default_rng(seed), []
    for w in windows:
        out.append("".join(rng.permutation(list(w))))
        letters = sorted({c for c in w.lower() if LETTER.match(c)} | set("abcdefghijklmnopqrstuvwxyz"))
        out.append(w.lower().translate(str.maketrans(dict(zip(letters, rng.permutation(letters).tolist())))))
    return out


def fit(docs: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, epochs: int = EPOCHS, seed: int = 7, reject: bool = False) -> Network | None:
    """Trains on a bounded sample of (doc_id, text, lang) rows that may be learnt from; with reject, also on the class OTHER."""
    known = F.col("lang") != OTHER if reject else F.col("lang").isNotNull()
    rows = docs.where(may_learn(F.col("doc_id")) & known & F.col("text").isNotNull()).select("doc_id", "lang", "text")
    sample = seeded_sample(rows, F.col("doc_id"), F.col("lang"), docs_per_language, seed)
    room = F.greatest(F.length("text") - SEGMENT, F.lit(1))
    windows = [F.substring("text", (F.pmod(F.xxhash64("doc_id", F.lit(i)), room) + 1).cast("int"), F.lit(SEGMENT)) for i in range(WINDOWS_PER_DOC)]
    found = sample.select("doc_id", "lang", F.array(*windows).alias("w")).collect()
    found = sorted((r.doc_id, r.lang, w) for r in found for w in r.w if LETTER.search(w))
    labels = sorted({x[1] for x in found})
    if not labels:
        return None
    if reject:
        found += [(0, OTHER, w) for w in garbled([x[2] for x in found], seed)]
        labels = [OTHER, *labels]
    cells, owner, _ = segments([x[2] for x in found])
    target = np.array([labels.index(x[1]) for x in found])[owner]
    net = train(cells, target, labels, epochs, seed)
    if reject:  # no more than one clean window in a thousand may look rejected
        clean = probabilities(net, [x[2] for x in found if x[1] != OTHER])[:, labels.index(OTHER)]
        net.reject_from = max(REJECT_FROM, float(np.quantile(clean, 0.999)))
    return net


def probabilities(net: Network, texts: list[str]) -> np.ndarray:
    """Mean position probabilities [n, C] of texts that are not empty."""
    cells, owner, held = segments(texts)
    total = np.zeros((len(texts), len(net.labels)))
    for i in range(0, len(cells), CHUNK):
        part = cells[i : i + CHUNK]
        p = softmax(run_network(net, part)[0])
        p *= (part.T != 256)[:, None, :]
        np.add.at(total, owner[i : i + CHUNK], p.sum(0).T.astype(np.float64))
    size = np.bincount(owner, held, len(texts))
    return total / np.maximum(size, 1)[:, None]


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for every row of docs with (doc_id, text)."""
    small_batches(docs.sparkSession)
    schema = "doc_id long, held_out boolean, lang_pred string, score double"
    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))

    def label(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        pred, score = ["und"] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if net is not None and t and LETTER.search(t)]
        if known:
            p = probabilities(net, [texts[i] for i in known])
            for i, row in zip(known, p, strict=True):
                best = int(row.argmax())
                pred[i], score[i] = net.labels[best], float(min(1.0, row[best]))
        return pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(pred), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return ready.mapInArrow(per_batch(label), schema)


def keep_identified(docs: DataFrame, net: Network | None) -> DataFrame:
    """The rows of docs in a language that the network (fitted with reject) was taught, with all their columns.

    Texts that are null or without a letter go; texts too short to tell stay.
    """
    small_batches(docs.sparkSession)

    def keep(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column("text").to_pylist()
        known = [i for i, t in enumerate(texts) if net is not None and t and LETTER.search(t)]
        stay = []
        if known:
            other = probabilities(net, [texts[i] for i in known])[:, net.labels.index(OTHER)]
            size = np.array([len(texts[i].encode("utf-8", "replace")) for i in known])
            stay = [i for i, x in zip(known, other * size / (size + SHORT), strict=True) if x < net.reject_from]
        return batch.take(pa.array(stay, pa.int64()))

    return docs.mapInArrow(per_batch(keep), docs.schema)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))
