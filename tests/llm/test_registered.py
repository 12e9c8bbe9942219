"""Registered queries without an SQL twin, on their own columns: brute force where there is one, else contract and held-out results."""

import hashlib
import os
import re
import zlib

import pytest

from dutyweave.llm import personal_data, queries

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not here")
KINDS = ("email", "ip", "card", "phone")
EMAIL, IP = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD, PHONE = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def documents(spark, sf=SF):
    return spark.read.parquet(f"{sf}/documents.parquet").collect()


def held_out(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 3 == 1


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def base_rows(text):
    digits = lambda m: re.sub("[^0-9]", "", m.group())
    spans = [(m.start(), 0, m.end()) for m in EMAIL.finditer(text)]
    spans += [(m.start(), 1, m.end()) for m in IP.finditer(text) if all(int(p) <= 255 for p in m.group().split("."))]
    spans += [(m.start(), 2, m.end()) for m in CARD.finditer(text) if 14 <= len(digits(m)) <= 19 and luhn(digits(m))]
    spans += [(m.start(), 3, m.end()) for m in PHONE.finditer(text) if 10 <= len(digits(m)) <= 15]
    return sorted(spans)


def test_personal_data_query(spark, tmp_path):
    planted = [(900001, "mail bob@example.com or 10.0.0.1, card 4111 1111 1111 1111, tel +1 (017) 555-7713"), (900002, None), (900003, ""), (900004, "card 4111 1111 1111 1112, ip 300.1.1.1"), (900005, "😀 a@b.co " * 3 + "x" * 30_000 + " a@b.co"), (900005, "twice +49 30 1234567"), (900006, "contact: bob(at)example.com or bob [at] example.org")]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    extra = spark.createDataFrame(planted, "doc_id long, text string")
    docs.select("doc_id", "text").unionByName(extra).selectExpr("*", "1 AS spans", "2 AS n_email", "3 AS c", "4 AS kind").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.queries()["op7_personal_data"](spark, str(tmp_path)).collect()
    texts = [(d.doc_id, d.text or "") for d in spark.read.parquet(f"{tmp_path}/documents.parquet").collect()]
    want = []
    for doc_id, text in texts:
        base = base_rows(text)
        joined = ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in base)
        want.append((doc_id, *[sum(k == i for _, k, _ in base) for i in range(4)], hashlib.sha256(joined.encode()).hexdigest()))
    assert sorted((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == sorted(want)
    base_of = {}
    for doc_id, text in texts:
        base_of.setdefault(doc_id, []).append({f"{KINDS[k]}:{s}:{e}" for s, k, e in base_rows(text)})
    added = {}
    for r in got:
        spans = [x for x in r.spans.split(",") if x]
        places = [(int(s), KINDS.index(k), int(e)) for k, s, e in (x.split(":") for x in spans)]
        assert places == sorted(places) and len(set(spans)) == len(spans)
        assert any(b <= set(spans) for b in base_of[r.doc_id])
        if len(base_of[r.doc_id]) == 1:
            added[r.doc_id] = set(spans) - base_of[r.doc_id][0]
    assert {x.split(":")[0] for x in added[900006]} == {"email"}  # the method's own find, where no base pattern matches
    assert added[900002] == added[900003] == set()
    assert personal_data.luhn("4111111111111111") and not personal_data.luhn("4111111111111112")


def test_language_query(spark):
    docs = documents(spark)
    got = {r.doc_id: r for r in queries.queries()["op8_language_id"](spark, SF).collect()}
    assert sorted(got) == sorted(d.doc_id for d in docs)
    langs = {d.lang for d in docs if d.lang is not None}
    right = total = 0
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == held_out(d.doc_id) and 0 <= r.score <= 1
        none = not any(c.isalpha() for c in d.text or "")
        assert (r.lang_pred == "und") == none and (none or r.lang_pred in langs)
        if r.held_out and d.lang is not None and not none:
            right, total = right + (r.lang_pred == d.lang), total + 1
    assert total >= 30 and right >= 0.95 * total


def test_toxicity_query(spark):
    # the smallest table has too few toxic rows to learn from
    docs = documents(spark, LARGER)
    rows = queries.queries()["op2_toxicity"](spark, LARGER).collect()
    got = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and sorted(got) == sorted(d.doc_id for d in docs)
    assert all(r.held_out == held_out(r.doc_id) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    toxic = {x.doc_id: x.toxic for x in spark.read.parquet(f"{LARGER}/labels.parquet").collect()}
    tested = [(got[i].score, y) for i, y in toxic.items() if i in got and got[i].held_out and y is not None]
    yes, no = [s for s, y in tested if y == 1], [s for s, y in tested if y == 0]
    assert yes and no
    auc = sum((a > b) + 0.5 * (a == b) for a in yes for b in no) / (len(yes) * len(no))
    assert auc >= 0.85
