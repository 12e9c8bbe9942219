"""Personal data by weak supervision.

Patterns give the base spans of four kinds. Looser patterns give further candidates.
Four labelers vote on every candidate: the strict pattern, a loose shape, a gazetteer
(known address endings, country codes, card prefixes, private networks) and words of
the context. Vote patterns are counted over all documents; expectation-maximisation
of a two-class model per kind estimates each labeler's reliability from these counts
alone, and the posteriors of a bounded sample of candidates train the final span
classifier, a logistic regression on shape and context. Candidates it accepts that
overlap no base span are added; base spans always stay.

Defined results for odd input: a null text counts as empty and has no spans; repeated
rows get equal spans; a null doc_id passes through; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dutyweave.llm.batches import per_batch, small_batches
from dutyweave.staging import stage

KINDS = ("email", "ip", "card", "phone")
LABELERS = ("strict", "loose", "gazetteer", "context")
#: Bound of the classifier's training sample.
TRAIN_SPANS = 20_000
ACCEPT = 0.9
CONTEXT_CHARS = 24

LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# possessive digits and the look-behind only spare retries inside one run of digits
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
LOOSE = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+ ?(?:\(at\)|\[at\]) ?[A-Za-z0-9-]{1,64}+(?:(?:\.| ?(?:\(dot\)|\[dot\]) ?)[A-Za-z0-9-]{1,64}+){1,4}", re.I),
    "ip": re.compile(r"(?<![0-9A-Fa-f:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Fa-f:])"),
    "card": re.compile(r"(?<![0-9.])[0-9]{4}[./][0-9]{4}[./][0-9]{4}[./][0-9]{4}(?![0-9.])"),
    "phone": re.compile(r"(?<![0-9+.])(?:00[1-9]|\(0)[ ()./0-9-]{6,24}[0-9](?![0-9])"),
}
CUES = {
    "email": re.compile(r"mail|contact|kontakt|correo|courriel|address|schreib", re.I),
    "ip": re.compile(r"\bip\b|host|server|addr|client|login|network", re.I),
    "card": re.compile(r"card|karte|carte|tarjeta|visa|master|payment|credit", re.I),
    "phone": re.compile(r"phone|tel|call|fax|mobil|handy|ruf|llam|appel", re.I),
}
ENDINGS = frozenset("com net org edu gov info de fr es it uk eu io example".split())
CANDIDATE = "kind int, s int, e int, base boolean, votes int, x array<float>"


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 4 and int(part or 0) <= 255


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @: the local part is the whole run before it."""
    found, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and LOCAL.match(text[start - 1]):
            start -= 1
        m = DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            found.append((start, end))
        else:
            end = max(end, at + 1)
        at = text.find("@", max(end, at + 1))
    return found


def base_spans(text: str) -> list[list[tuple[int, int]]]:
    """Spans of each kind, by the strict patterns."""
    ips = [m.span() for m in IP.finditer(text) if all(map(_small, m.group().split(".")))]
    cards = []
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 14:
            digits = re.sub("[ -]", "", m.group())
            if 14 <= len(digits) <= 19 and luhn(digits):
                cards.append(m.span())
    phones = [m.span() for m in PHONE.finditer(text) if 10 <= sum(map(str.isdigit, m.group())) <= 15] if "+" in text else []
    return [emails(text) if "@" in text else [], ips, cards, phones]


def gazetteer(kind: int, span: str) -> bool:
    digits = "".join(c for c in span if c in "0123456789")
    if kind == 0:
        return re.split(r"[^A-Za-z0-9]+", span.lower())[-1] in ENDINGS
    if kind == 1:
        return ":" in span or digits.startswith(("10", "192168", "172"))
    if kind == 2:
        return digits[:1] in set("3456")
    return digits.lstrip("0")[:2] in {"1", "33", "34", "39", "41", "43", "44", "49"} or digits.lstrip("0")[:1] == "1"


def candidates(text: str | None) -> list[tuple[int, int, int, bool, int, list[float]]]:
    """(kind, start, end, base, votes, features) of all candidates of a text, in order of start, then kind."""
    if not text:
        return []
    found = []
    for k, (spans, name) in enumerate(zip(base_spans(text), KINDS, strict=True)):
        taken = set(spans)
        rows = [(s, e, True) for s, e in spans]
        for m in LOOSE[name].finditer(text) if _may_hold(k, text) else ():
            if m.span() not in taken and not any(m.start() < e and s < m.end() for s, e in spans):
                rows.append((*m.span(), False))
        for s, e, base in rows:
            span, near = text[s:e], text[max(0, s - CONTEXT_CHARS) : s] + " " + text[e : e + CONTEXT_CHARS // 2]
            digits = sum(c.isdigit() for c in span)
            loose = base or (10 <= digits <= 15 if k == 3 else luhn("".join(c for c in span if c.isdigit() and c.isascii())) if k == 2 else True)
            votes = base + 2 * loose + 4 * gazetteer(k, span) + 8 * bool(CUES[name].search(near))
            edge = (s == 0 or not text[s - 1].isalnum()) + (e == len(text) or not text[e].isalnum())
            found.append((k, s, e, base, votes, [float(loose), float(votes >> 2 & 1), float(votes >> 3 & 1), edge / 2, digits / max(1, e - s), min(1.0, (e - s) / 40)]))
    return sorted(found, key=lambda r: (r[1], r[0]))


def _may_hold(kind: int, text: str) -> bool:
    if kind == 0:
        low = text.lower()
        return "(at)" in low or "[at]" in low
    return True


def reliabilities(counts: dict[tuple[int, int], int], rounds: int = 100) -> dict[tuple[int, int], float]:
    """Posterior of every (kind, votes) from the number of its candidates, by expectation-maximisation."""
    posterior = {}
    for kind in range(len(KINDS)):
        seen = sorted((v, n) for (k, v), n in counts.items() if k == kind)
        if not seen:
            continue
        votes = np.array([[v >> i & 1 for i in range(len(LABELERS))] for v, _ in seen], float)
        n = np.array([c for _, c in seen], float)
        prior, right, wrong = 0.7, np.array([0.9, 0.9, 0.7, 0.6]), np.array([0.05, 0.4, 0.3, 0.1])
        for _ in range(rounds):
            yes = prior * np.prod(np.where(votes == 1, right, 1 - right), 1)
            no = (1 - prior) * np.prod(np.where(votes == 1, wrong, 1 - wrong), 1)
            p = yes / (yes + no)
            a, b = (n * p).sum(), (n * (1 - p)).sum()
            # each estimate starts from some weak counts, so that no labeler becomes certain
            prior = (a + 7) / (a + b + 10)
            right = np.clip(((n * p) @ votes + 8) / (a + 10), 0.05, 0.99)
            wrong = np.clip(((n * (1 - p)) @ votes + 2) / (b + 10), 0.01, 0.95)
        posterior.update({(kind, v): float(x) for (v, _), x in zip(seen, p, strict=True)})
    return posterior


def train(kinds: np.ndarray, x: np.ndarray, target: np.ndarray, rounds: int = 800) -> np.ndarray:
    """Weights [kinds, features + 1] of a logistic regression for each kind on soft labels."""
    weights = np.zeros((len(KINDS), x.shape[1] + 1))
    x1 = np.hstack([x, np.ones((len(x), 1))])
    for k in range(len(KINDS)):
        a, y = x1[kinds == k], target[kinds == k]
        for _ in range(rounds if len(a) else 0):
            p = 1 / (1 + np.exp(-a @ weights[k]))
            weights[k] -= 1.0 * (a.T @ (p - y) / len(a) + 1e-3 * weights[k])
    return weights


def find_spans(docs: DataFrame, train_spans: int = TRAIN_SPANS, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, spans array<struct<kind, s, e, base>>) of every row of docs with (doc_id, text)."""
    spark = docs.sparkSession
    small_batches(spark)
    kind_type = pa.list_(
        pa.struct([("kind", pa.int32()), ("s", pa.int32()), ("e", pa.int32()), ("base", pa.bool_()), ("votes", pa.int32()), ("x", pa.list_(pa.float32()))])
    )
    names = [f.name for f in kind_type.value_type]

    def collect(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = [[dict(zip(names, c, strict=True)) for c in candidates(t)] for t in batch.column("text").to_pylist()]
        return pa.record_batch([batch.column("doc_id"), pa.array(rows, kind_type)], ["doc_id", "c"])

    ready = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = stage(ready.mapInArrow(per_batch(collect), f"doc_id long, c array<struct<{CANDIDATE.replace(' ', ':').replace(',:', ', ')}>>"), "pii-candidates")
    each = found.select("doc_id", F.explode("c").alias("c")).select("doc_id", "c.*")
    counts = {(r["kind"], r["votes"]): r["count"] for r in each.groupBy("kind", "votes").count().collect()}
    posterior = reliabilities(counts)
    total = sum(counts.values())
    weights = np.zeros((len(KINDS), 7))
    if total:
        share = min(1.0, train_spans / total)
        sample = each.where(F.pmod(F.xxhash64("doc_id", "s", "kind"), F.lit(1_000_003)) < int(share * 1_000_003) + 1).select("doc_id", "s", "kind", "votes", "x").collect()
        sample.sort(key=lambda r: (r.doc_id is None, r.doc_id or 0, r.s, r.kind))
        if sample:
            weights = train(
                np.array([r.kind for r in sample]), np.array([r.x for r in sample], float), np.array([posterior[(r.kind, r.votes)] for r in sample])
            )
    table = F.array(*[F.array(*[F.lit(float(w)) for w in row]) for row in weights])

    def accepted(c):
        w = table[c["kind"]]
        z = F.aggregate(F.sequence(F.lit(0), F.lit(5)), w[6], lambda acc, i: acc + w[i] * c["x"][i].cast("double"))
        return c["base"] | (1 / (1 + F.exp(-z)) >= accept)

    return found.select("doc_id", F.transform(F.filter("c", accepted), lambda c: F.struct(c["kind"].alias("kind"), c["s"].alias("s"), c["e"].alias("e"), c["base"].alias("base"))).alias("spans"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_spans(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    name = F.array(*[F.lit(k) for k in KINDS])

    def joined(rows):
        ordered = F.array_sort(F.transform(rows, lambda c: F.struct(c["s"].alias("s"), c["kind"].alias("kind"), c["e"].alias("e"))))
        return F.array_join(F.transform(ordered, lambda c: F.concat_ws(":", name[c["kind"]], c["s"].cast("string"), c["e"].cast("string"))), ",")

    def count(kind: int):
        return F.size(F.filter("spans", lambda c: c["base"] & (c["kind"] == kind))).cast("long")

    base = F.filter("spans", lambda c: c["base"])
    return spans.select(
        "doc_id",
        *[count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)],
        F.sha2(F.encode(joined(base), "UTF-8"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
