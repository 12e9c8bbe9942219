"""Toxicity by a subsequence string-kernel support vector machine with Nystroem landmarks.

The kernel of two strings sums decay^span over their common subsequences of LENGTH
characters, gaps included, and is normalised; it stays high when characters are
inserted into a word or left out. A sentence's kernel with a landmark is that of its
best matching word; words are taken without their punctuation, and runs of single
characters ("a b c d") also as one word. Landmarks are words that set toxic training
documents apart. Nystroem features K_mm^(-1/2) k of sentences feed a linear support
vector machine that is trained on labelled sentences: every sentence of a clean
document is negative, the best sentences of a toxic one are positive, chosen again in
each round. A document's score is the calibrated margin of its worst sentence.

Kernels below FLOOR count as 0. A word and a landmark need no evaluation where the
letters they share bound their kernel below FLOOR: by Cauchy-Schwarz it is at most the
share of the landmark's own norm that its subsequences of those letters carry. That
share is tabulated for every set of a landmark's letters, so nothing at or above FLOOR
is skipped.

Defined results for odd input: null and empty texts get the score of a sentence
without any match; without labelled rows of both kinds all scores are the share of
toxic labels learnt from (0 without any); a null doc_id is neither held out nor learnt
from; a document with several labels counts as toxic if one says so; repeated rows get
equal scores; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyweave.llm.batches import held_out, may_learn, per_batch, seeded_sample, small_batches

LENGTH = 3
START = "^"
DECAY = 0.7
FLOOR = 0.5
LANDMARKS = 96
WORD_MAX = 24
#: Letter classes of a landmark whose sets are tabulated.
GATE_LETTERS = 12
#: Bounds of the training sample: documents of each label, characters of a training document.
DOCS_PER_LABEL = 1500
TRAIN_CHARS = 20_000
THRESHOLD = 0.7
#: Log-likelihood ratio a landmark word needs; far above what chance gives among some 10^5 words.
MIN_GAIN = 24.0
#: Kernel of a word with itself after an insertion; such copies of positive sentences are trained on too.
WORN = 0.6
#: Words a task remembers before it starts afresh.
MEMORY = 200_000
SENTENCE = re.compile(r"(?<=[.!?\n])\s+")
SPACED = re.compile(r"(?<!\S)\S(?: \S){3,}(?!\S)")


def letters(words: list[str]) -> list[str]:
    """Words as they are compared: letters and digits after a mark for the word's start."""
    return [START + "".join(filter(str.isalnum, w)) for w in words]


def pad(words: list[str]) -> np.ndarray:
    """Code points [width, n], a word a column; unused cells are 0."""
    size = np.array([len(w) for w in words])
    out = np.zeros((int(size.max()), len(words)), np.int32)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.int32)
    column = np.repeat(np.arange(len(words)), size)
    out[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), column] = flat
    return out


def raw_kernel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Subsequence kernels of the columns of a [la, n] and b [lb, n], by the usual recursion over prefixes."""
    (la, n), lb = a.shape, len(b)
    same = ((a[:, None] == b[None]) & (a[:, None] != 0)).astype(np.float32)
    prefix = np.ones((la + 1, lb + 1, n), np.float32)
    for _ in range(LENGTH - 1):
        hit = same * prefix[:-1, :-1]
        hit *= DECAY**2
        nxt = np.zeros_like(prefix)
        for j in range(1, lb):
            hit[:, j] += DECAY * hit[:, j - 1]
        nxt[1:, 1:] = hit
        for i in range(2, la + 1):
            nxt[i] += DECAY * nxt[i - 1]
        prefix = nxt
    return (same * prefix[:-1, :-1]).sum((0, 1)) * DECAY**2


def self_kernel(words: list[str]) -> np.ndarray:
    out = np.zeros(len(words), np.float32)
    for i in range(0, len(words), 1024):
        p = pad(words[i : i + 1024])
        out[i : i + 1024] = raw_kernel(p, p)
    return out


def letter_mask(words: list[str]) -> np.ndarray:
    """Which of 64 letter classes each word holds."""
    size = np.array([len(w) for w in words])
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    bits = np.uint64(1) << (flat % np.uint64(64))
    return np.bitwise_or.reduceat(bits, np.cumsum(size) - size) if len(words) else np.zeros(0, np.uint64)


def gate(landmark: str) -> tuple[np.ndarray, np.ndarray]:
    """(letter classes as bits, may): may[s] is False where sharing just the classes of s bounds the kernel below FLOOR.

    s has a bit for each of the first GATE_LETTERS classes; any others count as shared.
    """
    cells = pad([landmark])[:, 0]
    own = np.unique(cells % 64)[:GATE_LETTERS]
    sets = np.arange(1 << len(own))
    part = np.repeat(cells[:, None], len(sets), 1)
    for i, c in enumerate(own):
        part[np.ix_(cells % 64 == c, (sets >> i & 1) == 0)] = 0
    norm = np.concatenate([raw_kernel(part[:, i : i + 1024], part[:, i : i + 1024]) for i in range(0, len(sets), 1024)])
    return own.astype(np.uint64), norm >= FLOOR**2 * norm[-1] * (1 - 1e-4)


def may_match(mask: np.ndarray, gates: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """(word, landmark) pairs whose shared letters allow a kernel of FLOOR."""
    rows, cols = [], []
    for j, (own, may) in enumerate(gates):
        at = np.zeros(len(mask), np.int64)
        for i, c in enumerate(own):
            at |= ((mask >> c & np.uint64(1)) << np.uint64(i)).astype(np.int64)
        hit = np.flatnonzero(may[at])
        rows.append(hit)
        cols.append(np.full(len(hit), j))
    return np.concatenate(rows), np.concatenate(cols)


@dataclass
class Model:
    """landmarks with their self-kernels; weights on the raw kernel vector (projection folded in); calibration."""

    landmarks: list[str] = field(default_factory=list)
    gates: list = field(default_factory=list)
    own: np.ndarray | None = None
    weight: np.ndarray | None = None
    bias: float = 0.0
    slope: float = 0.0
    shift: float = 0.0
    constant: float | None = None

    def probability(self, margin: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(margin), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def pieces(word: str) -> list[str]:
    """A long word as overlapping windows, so that all of it is compared."""
    if len(word) <= WORD_MAX:
        return [word]
    half = WORD_MAX // 2
    return [word[i : i + WORD_MAX] for i in range(0, len(word) - half, half)]


def kernels(words: list[str], landmarks: list[str], own: np.ndarray, gates: list | None = None) -> np.ndarray:
    """Normalised kernels [n, m] of letter strings with the landmarks, 0 below FLOOR."""
    split = [(i, p) for i, w in enumerate(words) for p in pieces(w) if len(p) >= LENGTH]
    out = np.zeros((len(words), len(landmarks)), np.float32)
    if not split:
        return out
    part = [p for _, p in split]
    at, to = may_match(letter_mask(part), gates if gates is not None else [gate(w) for w in landmarks])
    used, back = np.unique(at, return_inverse=True)
    norm = self_kernel([part[i] for i in used]) if len(used) else np.zeros(0)
    marks = pad(landmarks)
    by_size = np.argsort(np.array([len(part[k]) for k in at]), kind="stable")
    at, to, back = at[by_size], to[by_size], back[by_size]
    value = np.zeros(len(at), np.float32)
    for i in range(0, len(at), 1024):
        s = slice(i, i + 1024)
        mine = pad([part[k] for k in at[s]])
        value[s] = raw_kernel(mine, marks[:, to[s]]) / np.sqrt(np.maximum(norm[back[s]] * own[to[s]], 1e-12))
    value[value < FLOOR] = 0
    np.maximum.at(out, (np.array([split[k][0] for k in at], np.int64), to), value)
    return out


def sentence_words(text: str) -> list[list[str]]:
    """Words of each sentence, in lower case and as written; spaced-out words are added joined."""
    found = []
    for sentence in SENTENCE.split(text.lower()):
        words = sentence.split()
        words += [m.group().replace(" ", "") for m in SPACED.finditer(sentence)]
        if words:
            found.append(words)
    return found


def choose_landmarks(docs: list[tuple[list[list[str]], int]], count: int) -> list[str]:
    """Words and word beginnings whose documents are toxic more often than chance explains, by their log-likelihood ratio.

    Of a word and its beginnings only the one with the highest ratio stays.
    """
    held = {0: Counter(), 1: Counter()}
    for sentences, toxic in docs:
        words = {w for s in sentences for w in letters(s) if LENGTH < len(w)}
        held[toxic].update({w[:n] for w in words for n in range(5, min(len(w), 10) + 1)} | {w for w in words if len(w) <= 16})
    n = Counter(t for _, t in docs)
    share = n[1] / len(docs)
    words = [w for w, c in held[1].items() if c >= 3]
    if not words:
        return []
    p, q = np.array([held[1][w] for w in words], float), np.array([held[0][w] for w in words], float)
    rate = p / (p + q)
    gain = 2 * (p * np.log(rate / share) + np.where(q > 0, q * np.log(np.maximum(1 - rate, 1e-12) / (1 - share)), 0))
    keep = np.flatnonzero((rate > share) & (rate > 0.8) & (gain > MIN_GAIN))
    chosen: list[str] = []
    for i in sorted(keep, key=lambda i: (-round(gain[i], 6), -len(words[i]), words[i])):
        if not any(words[i].startswith(c) or c.startswith(words[i]) for c in chosen):
            chosen.append(words[i])
    return chosen[:count]


def pool(sentences: list[list[str]], table: dict[str, np.ndarray], m: int) -> np.ndarray:
    """Kernel vectors [n, m] of sentences: the best word for each landmark."""
    out = np.zeros((len(sentences), m), np.float32)
    for i, s in enumerate(sentences):
        for w in s:
            k = table.get(w)
            if k is not None:
                np.maximum(out[i], k, out=out[i])
    return out


def table_of(words: set[str], landmarks: list[str], own: np.ndarray, gates: list | None = None) -> dict[str, np.ndarray]:
    """Kernel vectors of the words that match some landmark."""
    names = sorted(words)
    k = kernels(letters(names), landmarks, own, gates)
    return {names[i]: k[i] for i in np.flatnonzero(k.any(1))}


def svm(x: np.ndarray, y: np.ndarray, c: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, float]:
    """Linear support vector machine (squared hinge loss with costs c) by accelerated gradient descent."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    w, v = np.zeros(x1.shape[1]), np.zeros(x1.shape[1])
    ridge = np.append(np.full(x.shape[1], 1e-3), 1e-6)
    step = 1 / (2 * np.linalg.norm(x1 * np.sqrt(c)[:, None], 2) ** 2 + 1e-3)
    for i in range(rounds):
        slack = np.maximum(0, 1 - y * (x1 @ v))
        new = v - step * (ridge * v - 2 * x1.T @ (c * slack * y))
        v, w = new + i / (i + 3) * (new - w), new
    return w[:-1], float(w[-1])


def fit_texts(rows: list[tuple[str, int]], landmark_count: int = LANDMARKS) -> Model:
    """Trains on (text, toxic) rows."""
    docs = [(sentence_words(t), y) for t, y in rows]
    toxic = sum(y for _, y in docs)
    if not docs or toxic in (0, len(docs)):
        return Model(constant=toxic / len(docs) if docs else 0.0)
    landmarks = choose_landmarks(docs, landmark_count)
    if not landmarks:
        return Model(constant=toxic / len(docs))
    own, gates = self_kernel(landmarks), [gate(w) for w in landmarks]
    table = table_of({w for s, _ in docs for x in s for w in x}, landmarks, own, gates)
    mm = kernels(landmarks, landmarks, own, gates)
    value, vector = np.linalg.eigh((mm + mm.T) / 2 + 1e-3 * np.eye(len(landmarks)))
    project = vector @ np.diag(np.maximum(value, 1e-3) ** -0.5) @ vector.T
    pooled = [pool(s, table, len(landmarks)) for s, _ in docs]
    nothing = np.zeros((1, len(landmarks)), np.float32)
    negative = np.concatenate([nothing] + [p[p.any(1)] for p, (_, y) in zip(pooled, docs, strict=True) if not y]) @ project
    worth = [p.max(1) if len(p) else np.zeros(0) for p in pooled]
    weight, bias = np.zeros(len(landmarks)), 0.0
    for _ in range(3):
        best = [p[np.argsort(-w)[:2]] for p, w, (_, y) in zip(pooled, worth, docs, strict=True) if y]
        positive = np.concatenate([b[b.any(1)] for b in best] + [nothing[:0]]) @ project
        if not len(positive):
            break
        positive = np.concatenate([positive, WORN * positive])
        x = np.concatenate([positive, negative])
        y = np.append(np.ones(len(positive)), -np.ones(len(negative)))
        cost = np.append(np.full(len(positive), 1 / len(positive)), np.full(len(negative), 1 / len(negative)))
        cost[len(positive)] = 0.5  # the sentence without any match
        weight, bias = svm(x, y, cost * 100)
        worth = [p @ (project @ weight) for p in pooled]
    weight = project @ weight
    margin = np.array([max([bias, *(p @ weight + bias)]) for p in pooled])
    target = np.array([y for _, y in docs], float)
    slope, shift = 1.0, 0.0
    for _ in range(2000):  # calibration: logistic regression on the margin
        e = 1 / (1 + np.exp(-np.clip(slope * margin + shift, -40, 40))) - target
        slope, shift = slope - 0.5 * ((e * margin).mean() + 1e-4 * slope), shift - 0.5 * e.mean()
    return Model(landmarks, gates, own, weight.astype(np.float32), bias, slope, shift)


def fit(docs: DataFrame, labels: DataFrame, docs_per_label: int = DOCS_PER_LABEL, train_chars: int = TRAIN_CHARS) -> Model:
    """Trains on a bounded, seeded sample of labelled rows that may be learnt from."""
    known = labels.where("doc_id IS NOT NULL AND toxic IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col("toxic").cast("int")).alias("_toxic"))
    rows = docs.where(may_learn(F.col("doc_id")) & (F.length("text") <= train_chars)).select(F.col("doc_id").cast("long").alias("_id"), "text")
    sample = seeded_sample(rows.join(known, "_id"), F.col("_id"), F.col("_toxic"), docs_per_label, 5)
    found = sorted((r._id, r.text, int(r._toxic > 0)) for r in sample.collect())
    return fit_texts([(t, y) for _, t, y in found])


class Scorer:
    """Margins of documents; keeps what it learnt about words between batches, up to MEMORY words."""

    def __init__(self, model: Model) -> None:
        self.model, self.seen, self.table = model, set(), {}

    def margins(self, texts: list[str | None]) -> np.ndarray:
        m = self.model
        out = np.full(len(texts), m.bias)
        if m.constant is not None:
            return out
        lower = [(t or "").lower() for t in texts]
        words = [set(t.split()) for t in lower]
        for w, t in zip(words, lower, strict=True):
            w.update(x.group().replace(" ", "") for x in SPACED.finditer(t))
        fresh = set().union(*words) - self.seen
        if fresh:
            if len(self.seen) > MEMORY:
                self.seen, self.table, fresh = set(), {}, set().union(*words)
            self.table.update(table_of(fresh, m.landmarks, m.own, m.gates))
            self.seen |= fresh
        for i, w in enumerate(words):
            if not self.table.keys().isdisjoint(w):
                out[i] = max(m.bias, float((pool(sentence_words(lower[i]), self.table, len(m.landmarks)) @ m.weight).max()) + m.bias)
        return out


def score(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of docs."""
    small_batches(docs.sparkSession)

    def run(batches):
        scorer = Scorer(model)

        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            p = model.probability(scorer.margins(batch.column("text").to_pylist()))
            return pa.record_batch(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(p), pa.array((p >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"]
            )

        yield from per_batch(one)(batches)

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return ready.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
