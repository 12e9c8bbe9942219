"""The operators against brute force on small fixtures, and their defined results for odd input."""

import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from dutyweave.llm import batches, collision_search, components, exact_dedup, language_id, mixing, ngram_join, personal_data, piece_sampling, suffix_dedup, toxicity, url_filter

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(5, 90))) for _ in range(n // 3)]
    rows = []
    for i in range(n):
        t = rng.choice(base)
        k = rng.random()
        if k < 0.3:
            t = t.replace(" ", "  \n", 2)
        elif k < 0.6:
            w = t.split()
            w[rng.randrange(len(w))] = "new" + str(i)
            t = " ".join(w)
        elif k < 0.8:
            t = rng.choice(base) + ". " + t
        rows.append((i, t, rng.choice(["en", "de"]), rng.choice(["s1", "s2", None]), len(t)))
    return rows + [(n, None, None, None, None), (n + 1, "", "en", "s1", 0), (n + 2, " \n", None, "s2", 2), (None, "one two three four five six", "en", "s1", 27), (n + 3, "x" * 5000, "en", "s3", 5000)]


@pytest.fixture(scope="module")
def rows():
    return corpus()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).withColumnRenamed("n_chars", "n_chars").selectExpr("*", "1 AS n", "'clash' AS sha", "2 AS size", "3 AS component")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_exact_dedup(docs, rows, empty):
    got = {r.doc_id: r for r in exact_dedup.exact_duplicates(docs, 64, 4).collect()}
    groups = collections.defaultdict(list)
    for i, t, *_ in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    for norm, members in groups.items():
        keep = min(members, key=lambda m: (-len(m[1]), m[0] is None, m[0] or 0))[0]
        for i, _ in members:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (keep, len(members), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    assert exact_dedup.exact_duplicates(empty).count() == 0
    assert exact_dedup.drop_duplicates(docs).count() == len(groups)
    assert exact_dedup.drop_duplicates(docs).columns == docs.columns


def seats(votes, n):
    won = [0] * len(votes)
    for _ in range(n):
        k = max(range(len(votes)), key=lambda i: (votes[i] / (2 * won[i] + 1), -i))
        won[k] += 1
    return won


def test_apportionment_is_highest_quotients(spark):
    rng = random.Random(4)
    rows, want = [], {}
    for g in range(12):
        votes = [rng.choice([0, 1, 5, 40, 1000, rng.randint(1, 10**6)]) for _ in range(rng.randint(1, 9))]
        n = rng.randint(0, 60)
        rows += [(g, i, float(v), n) for i, v in enumerate(votes)]
        want |= {(g, i): s for i, s in enumerate(seats(votes, n if sum(votes) else 0))}
    df = spark.createDataFrame(rows, "g int, p int, v double, s int")
    got = {(r.g, r.p): r.quota for r in mixing.apportion(df, ["g"], "p", "v", "s").collect()}
    assert got == want


def test_mixing(docs, rows, empty, spark):
    sizes = mixing.document_sizes(docs)
    got = mixing.mix_rows(sizes).collect()
    size = {i: len(WORD.findall(t or "")) for i, t, *_ in rows}
    by = collections.defaultdict(int)
    for i, _, _, s, _ in rows:
        by[s] += size[i]
    names = sorted(by, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    full, total = set(), 1.5 * sum(by.values())
    while True:
        rest = total - sum(2 * by[s] for s in full)
        w = sum(weight[s] for s in names if s not in full)
        above = [s for s in names if s not in full and weight[s] * rest / w > 2 * by[s]]
        if not above:
            break
        full |= set(above)
    target = {s: 2.0 * by[s] if s in full else weight[s] * rest / w for s in names}
    taken = collections.defaultdict(int)
    for r in got:
        assert r["size"] == size[r.doc_id] and r.source_size == by[r.source] and abs(r.target - target[r.source]) < 1e-6
        assert 0 <= r.taken <= 2 * r["size"]
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= mixing.BLOCK_WORDS for s in names)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix_rows(sizes.repartition(5)).collect()))
    assert mixing.mix_rows(mixing.document_sizes(empty)).count() == 0
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    assert sum(len(WORD.findall(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_collision_search(spark):
    rng = np.random.default_rng(5)
    centre = rng.normal(size=(12, 16))
    x = (centre[rng.integers(0, 12, 700)] + 0.4 * rng.normal(size=(700, 16))) * rng.uniform(0.5, 2, (700, 1))
    x[100:130] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    odd = [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] * 16), (1003, [1.0, None] * 8), (1004, [1.0] * 3), (None, [1.0] * 16), (1020, [float("inf")] * 16)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>")
    got = collections.defaultdict(list)
    for r in collision_search.nearest(df, 20, 10, index_rows=200, query_rows=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r["rank"], r.vec_id, r.score))
    hit = total = 0
    assert set(got) == set(range(0, 700, 20))
    for q, found in got.items():
        s = (x * x[q]).sum(1)
        s[q] = -np.inf
        best = np.lexsort((np.arange(700), -s))[:10]
        hit, total = hit + len({v for _, v, _ in found} & set(best.tolist())), total + 10
        assert [k for k, _, _ in found] == list(range(1, 11)) and found == sorted(found, key=lambda f: (-f[2], f[1]))
        assert all(abs(sc - s[v]) < 1e-9 for _, v, sc in found)
    assert hit >= 0.95 * total
    few = spark.createDataFrame(rows[:4], "vec_id long, embedding array<double>")
    assert collision_search.nearest(few, 20, 10).count() == 3
    assert collision_search.nearest(df.limit(0)).count() == 0


def brute_nearest(rows, every, k):
    """query_id to its k nearest (vec_id, score) among rows (vec_id, vector)."""
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    out = {}
    for q in np.flatnonzero(ids % every == 0):
        s = np.where(ids == ids[q], -np.inf, (x * x[q]).sum(1))
        best = [j for j in np.lexsort((ids, -s))[:k] if s[j] > -np.inf]
        out[int(ids[q])] = [(int(ids[j]), float(s[j])) for j in best]
    return out


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_of_the_search_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"/root/testdata/{sf}/embeddings.parquet").collect()]
    want = brute_nearest(rows, 20, 20)
    got = collections.defaultdict(list)
    for r in collision_search.op3_collision_search(spark, f"/root/testdata/{sf}").orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = sum(len({i for i, _ in got[q]} & {i for i, _ in found}) for q, found in want.items())
    assert set(got) == set(want) and all(len(f) == 20 for f in got.values())
    assert hit >= 0.99 * sum(map(len, want.values()))


def test_search_of_large_repeated_and_clustered_vectors(spark):
    huge = [(i, [1e200 * (i + 1), 1e200 * (i % 7), -1e199 * i]) for i in range(50)]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "'x' AS cell", "2 AS s")
    found = collision_search.nearest(df, 10, 3).where("query_id = 20").orderBy("rank").collect()
    small = [(i, [x / 1e200 for x in v]) for i, v in huge]
    assert [r.vec_id for r in found] == [i for i, _ in brute_nearest(small, 10, 3)[20]] and all(r.score == float("inf") for r in found)
    rng = np.random.default_rng(8)
    centre = 10 * rng.normal(size=(20, 8))
    rows = [(i, list(map(float, centre[i % 20] + 0.05 * rng.normal(size=8)))) for i in range(2000)]
    rows += [(5000 + i, rows[40][1]) for i in range(300)] + [rows[40]] * 3  # one common vector, one repeated row
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = brute_nearest(rows, 20, 20)
    got = collections.defaultdict(list)
    for r in collision_search.nearest(df, 20, 20, index_rows=100, query_rows=16, cells=20).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    hit = sum(sum((collections.Counter(i for i, _ in got[q]) & collections.Counter(i for i, _ in found)).values()) for q, found in want.items())
    assert set(got) == set(want) and hit >= 0.97 * sum(map(len, want.values()))


def brute_repeats(rows):
    seen, out = set(), {}
    for i, t in sorted(((i, t) for i, t, *_ in rows if i is not None)):
        b = (t or "").encode()
        gone, mine = bytearray(len(b)), []
        for j in range(len(b) - 49):
            if b[j : j + 50] in seen:
                gone[j : j + 50] = b"\1" * 50
            else:
                mine.append(b[j : j + 50])
        seen.update(mine)
        out[i] = (len(b), [m.span() for m in re.finditer(b"\1+", bytes(gone))], bytes(x for x, g in zip(b, gone) if not g))
    return out


@pytest.mark.parametrize("shard_bytes", [1 << 20, 1500])
def test_suffix_dedup(spark, shard_bytes):
    rows = [(i, (t or "").encode().decode() if t is not None else None, *r) for i, t, *r in corpus(7, 50)]
    rows += [(900, "z" * 200, None, None, 0), (901, "y" + "z" * 120, None, None, 0), (902, "a\0b" * 40, None, None, 0), (903, "\0b" + "a\0b" * 30 + "é" * 60, None, None, 0)]
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_bytes, [(s.s, s.e) for s in r.spans], bytes(r.kept)) for r in suffix_dedup.remove_repeats(df, shard_bytes, shard_bytes).collect()}
    assert got.pop(None)[1] == []
    assert got == brute_repeats(rows)
    assert suffix_dedup.remove_repeats(df.limit(0)).count() == 0


def write_documents(spark, tmp_path, rows, name="documents"):
    spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' AS marks", "1 AS shard", "2 AS n", "'y' AS h").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def test_suffix_dedup_query(spark, tmp_path):
    rows = [r for r in corpus(11, 60) if r[0] is not None]
    rows += [(800 + i, ("long words of a very long text " * 3 + str(i)) * 400, None, None, 0) for i in range(3)]
    found = suffix_dedup.op5_suffix_dedup(spark, write_documents(spark, tmp_path, rows + [(None, "w" * 90, None, None, 0)])).collect()
    want = {i: (n, sum(b - a for a, b in spans), len(spans), hashlib.sha256(kept).hexdigest()) for i, (n, spans, kept) in brute_repeats(rows).items()}
    want[None] = (90, 0, 0, hashlib.sha256(b"w" * 90).hexdigest())
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found} == want and len(found) == len(rows) + 1


def hot_rows():
    rng = random.Random(5)
    filler = lambda n: "".join(rng.choice("abcdefghij ") for _ in range(n))
    phrases = [filler(70), filler(52), filler(35)]
    rows = [(i, filler(60) + " ".join(p + filler(rng.randint(1, 40)) for p in phrases)) for i in range(120)]
    rows += [(200 + i, filler(9) + rows[i][1][20:150] + filler(9)) for i in range(0, 120, 3)]
    return rows + [(None, phrases[0])] * 30


@pytest.mark.parametrize("shard_bytes", [1 << 20, 3000])
def test_suffix_dedup_of_hot_anchors(spark, shard_bytes):
    rows = hot_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, (r.n_bytes, [(s.s, s.e) for s in r.spans], bytes(r.kept))) for r in suffix_dedup.remove_repeats(df, shard_bytes, shard_bytes, many=4).collect()]
    assert [x for i, x in got if i is None] == [(70, [], rows[-1][1].encode())] * 30
    assert {i: x for i, x in got if i is not None} == brute_repeats(rows)


def test_suffix_dedup_bounds_hot_anchors_and_shared_ids(spark):
    rows = [r for r in hot_rows() if r[0] is not None]
    shard = suffix_dedup.Shard(pa.table({"doc_id": [r[0] for r in rows], "text": [r[1] for r in rows], "marks": suffix_dedup.marks([r[1].encode() for r in rows])}))
    assert np.unique(shard.h, return_counts=True)[1].max() >= 100
    listed, begin = shard.by_bucket(7, 4)
    assert np.unique(shard.h[listed], return_counts=True)[1].max() == 4 and begin[-1] == len(listed)
    name, count = np.unique(shard.h, return_counts=True)
    owner, bit, number, at, hashed, least = shard.windows_of(np.flatnonzero(shard.h == name[count.argmax()])[:4])
    data = bytes(shard.data)
    windows = [data[x : x + 50] for x in at]
    assert len(set(windows)) == len(windows) > 4
    assert all(data[(p := shard.lo[shard.head[e]] + b) : p + 50] == windows[n] and least[n] <= shard.least[e] for e, b, n in zip(owner, bit, number))
    same = spark.range(400).selectExpr("7L AS doc_id", "CAST(id AS STRING) AS text")
    assert same.select(suffix_dedup.shard_of(8).alias("s")).distinct().count() == 8


def test_suffix_array_and_prefixes():
    texts = [b"banana\0nana", b"anana", b"", b"banana"]
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    size = np.array([len(t) for t in texts])
    start = np.cumsum(size + 1) - size - 1
    text = raw.astype(np.uint16) + 1
    text[start + size] = 0
    lane = np.repeat(np.arange(4), size + 1)
    sa = suffix_dedup.suffix_array(text, lane)
    ends = np.repeat(start + size, size + 1)
    assert sa.tolist() == sorted(range(len(text)), key=lambda i: (text[i : ends[i]].tolist(), lane[i]))
    lcp = suffix_dedup.kasai(text, sa, start, size)
    for a, b in zip(sa, sa[1:]):
        if a < ends[a] and b < ends[b]:
            x, y = text[a : ends[a]].tolist(), text[b : ends[b]].tolist()
            assert lcp[b] == next((k for k in range(min(len(x), len(y))) if x[k] != y[k]), min(len(x), len(y)))


def test_url_filter(spark):
    urls = ["http://a.NET/x", "https://example.net/en/1", "x://sub.example.com/de/?q", "http://w.org/fr/#t", "http://w.org/fr", "http://net/", "nothing", None, "", "http://b.net", "://c.net/", "http://d.net:80/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    rules = spark.createDataFrame(list(url_filter.RULES), "host string, path string, verdict string")
    want = ["net/", "example.net/en/", "example.com/de/", "org/fr/", None, "net/", None, None, None, None, "net/", None]
    for bits in (1 << 20, 1):  # the cascade, and the way beyond its size
        got = {r.page_id: (r.rule, r.verdict) for r in url_filter.judge_urls(pages, rules, bits).collect()}
        assert got == {i: (w, "block" if w in ("net/", "example.com/de/") else "allow") for i, w in enumerate(want)}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}


def test_cascade_is_exact(spark):
    universe = spark.range(4000).selectExpr("concat('k', id) AS key")
    listed = universe.where("hash(key) % 9 = 0")
    levels = url_filter.build_cascade(listed, universe)
    assert len(levels) > 1
    assert universe.where(url_filter.cascade_contains(levels, universe["key"])).exceptAll(listed).count() == 0
    assert listed.where(~url_filter.cascade_contains(levels, listed["key"])).count() == 0


def test_personal_data(spark, docs, empty):
    rng = random.Random(9)
    email, ip = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
    card, phone = re.compile(r"[0-9]([\x20-]?[0-9])+"), re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
    for _ in range(4000):
        t = "".join(rng.choice("a1@.+- (9%5_0") for _ in range(rng.randint(0, 50)))
        digits = lambda s: re.sub(r"[^0-9]", "", s)
        want = [
            [m.span() for m in email.finditer(t)],
            [m.span() for m in ip.finditer(t) if all(int(p) <= 255 for p in m.group().split("."))],
            [m.span() for m in card.finditer(t) if 14 <= len(digits(m.group())) <= 19 and personal_data.luhn(digits(m.group()))],
            [m.span() for m in phone.finditer(t) if 10 <= len(digits(m.group())) <= 15],
        ]
        assert personal_data.base_spans(t) == want
    assert personal_data.base_spans("a" * 100_000 + "@" + "1" * 100_000)[0] == []
    texts = [("mail me: bob@example.com or 10.0.0.1, card 4111 1111 1111 1111, tel +1 (017) 555-7713", 1), (None, 2), ("", 3), ("contact: bob(at)example.com or bob [at] example.org", 4)]
    df = spark.createDataFrame(texts, "text string, doc_id long")
    got = {r.doc_id: [(personal_data.KINDS[s.kind], s.base) for s in r.spans] for r in personal_data.find_spans(df).collect()}
    assert [k for k, b in got[1] if b] == ["email", "ip", "card", "phone"] and got[2] == got[3] == []
    assert all(k == "email" and not b for k, b in got[4])
    assert personal_data.find_spans(docs).count() == docs.count()
    assert personal_data.find_spans(empty).count() == 0


def test_reliabilities_rank_labelers():
    p = personal_data.reliabilities({(0, 15): 900, (0, 2): 500, (0, 10): 20, (0, 7): 300})
    assert p[(0, 15)] > 0.9 > p[(0, 2)]


def test_language_id(spark, docs, empty):
    rng = random.Random(2)
    def text(k):
        return " ".join(("the cat and dog of it" if k == "en" else "der hund und die maus ist").split()[rng.randrange(6)] for _ in range(60))

    rows = [(i, text(k), k, "s", 0) for i in range(240) for k in [("en", "de")[i % 2]]]
    df = spark.createDataFrame(rows, SCHEMA)
    net = language_id.fit(df, 60, epochs=4)
    got = {r.doc_id: r for r in language_id.identify(df, net).collect()}
    assert sum(got[i].lang_pred == k for i, _, k, *_ in rows) >= 0.97 * len(rows)
    odd = {r.doc_id: (r.lang_pred, r.score) for r in language_id.identify(docs, net).collect()}
    assert odd[60] == odd[61] == odd[62] == ("und", 0.0)
    assert all(0 <= s <= 1 for _, s in odd.values())
    assert language_id.fit(empty) is None and language_id.identify(docs, None).where("lang_pred <> 'und'").count() == 0
    assert language_id.keep_identified(docs, net).columns == docs.columns


def test_network_gradient():
    rng = np.random.default_rng(0)
    cells = rng.integers(0, 256, (4, 10)).astype(np.int16)
    cells[1, 6:] = 256
    h = language_id.HIDDEN
    net = language_id.Network(["a", "b"], rng.normal(0, 0.5, (2, 3 * h, 257)), rng.normal(0, 0.4, (2, 3 * h, h)), rng.normal(0, 0.3, (2, 2 * h)), np.zeros(2))
    target = np.array([0, 1, 1, 0])
    _, g = language_id.gradients(net, cells, target)
    for k in ("emb", "rec", "out", "bias"):
        w, at = getattr(net, k), np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        old, e = w[at], 1e-2
        w[at] = old + e
        up = language_id.gradients(net, cells, target)[0]
        w[at] = old - e
        down = language_id.gradients(net, cells, target)[0]
        w[at] = old
        assert abs((up - down) / (2 * e) - g[k][at]) < 2e-3


def test_toxicity_kernel_and_scores(spark, docs, empty):
    import itertools

    def brute(s, t):
        def weights(x):
            out = collections.defaultdict(float)
            for at in itertools.combinations(range(len(x)), toxicity.LENGTH):
                out["".join(x[i] for i in at)] += toxicity.DECAY ** (at[-1] - at[0] + 1)
            return out

        a, b = weights(s), weights(t)
        return sum(a[k] * b[k] for k in a)

    for s, t in (("idiot", "idxiot"), ("moron", "moron"), ("abcabc", "acb")):
        assert abs(brute(s, t) - toxicity.raw_kernel(toxicity.pad([s]), toxicity.pad([t]))[0]) < 1e-5
    rng = random.Random(3)
    words = ["".join(rng.choice("abehklmnrstu") for _ in range(rng.randint(3, 8))) for _ in range(400)]
    def text(bad):
        w = [rng.choice(words) for _ in range(60)]
        if bad:
            w[rng.randrange(60)] = rng.choice(["wretch", "vermin"])
        return " ".join(w) + "."

    train = [(text(k % 3 == 0), int(k % 3 == 0)) for k in range(400)]
    model = toxicity.fit_texts(train)
    fresh = [(text(k % 2 == 0), k % 2 == 0) for k in range(200)]
    p = model.probability(toxicity.Scorer(model).margins([t for t, _ in fresh]))
    assert np.mean((p >= toxicity.THRESHOLD) == np.array([b for _, b in fresh])) > 0.97
    odd = model.probability(toxicity.Scorer(model).margins(["you vexrmin", "w r e t c h", "calm words", None, ""]))
    assert odd[0] > odd[2] and odd[1] > 0.7 and odd[2] == odd[3] == odd[4] < 0.3
    assert {r.predicted for r in toxicity.score(docs, toxicity.fit_texts([])).collect()} == {0}
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.score(empty, toxicity.fit(docs, labels)).count() == 0
    assert toxicity.score(docs, model).count() == docs.count()


def word_sets(rows, words):
    out = {}
    for i, t, *_ in rows:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out[i] = frozenset(tuple(w[k : k + words]) for k in range(max(1, len(w) - words + 1))) if w else frozenset()
    return out


@pytest.mark.parametrize(("words", "percent"), [(4, 85), (5, 80), (1, 60)])
def test_ngram_join(spark, words, percent, monkeypatch):
    monkeypatch.setattr(ngram_join, "LONG_LIST", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_TOKENS", 256)
    rows = corpus(11, 150)
    sets = word_sets(rows, words)
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    known = sorted(i for i in sets if i is not None)
    for a in known:
        for b in known:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.similar_groups(df, words, percent).collect()}
    assert got == {i: (len(s), root(i) if i is not None else None) for i, s in sets.items()}
    assert ngram_join.keep_one_of_each(df, words, percent).count() == len({root(i) for i in known}) + 1
    assert ngram_join.similar_groups(df.limit(0), words, percent).count() == 0


@pytest.mark.parametrize("size", [60, 200, 600, 1500, 3000])
def test_signatures_meet_where_counts_tie(size):
    rng = np.random.default_rng(size)
    for _ in range(20):
        base, more = (rng.integers(0, 1 << 63, n, np.uint64) for n in (size, size // 5))
        whole = np.unique(np.concatenate([base, more]))
        counts = np.where(np.isin(whole, base), 1000, rng.integers(64, 999, len(whole)))
        sets = [np.unique(base), whole, np.sort(rng.permutation(whole)[: size + size // 10])]
        entered = [ngram_join.signatures(s, whole, counts, 50, 80) for s in sets]
        for i, j in ((0, 1), (0, 2), (1, 2)):
            both = len(np.intersect1d(sets[i], sets[j]))
            if both * 180 >= 80 * (len(sets[i]) + len(sets[j])):
                assert len(np.intersect1d(entered[i], entered[j]))


def test_ngram_join_of_copies_with_longer_and_shorter_ones(spark):
    rng, rows, known = random.Random(3), [], []
    for size in (60, 200, 600, 1500):
        words = [f"w{rng.randrange(10**9)}" for _ in range(size)]
        for extra in [0] * 150 + list(range(1, size // 6, max(1, size // 60))):
            known.append(size)
            rows.append((len(rows), " ".join(words + [f"x{rng.randrange(10**9)}" for _ in range(extra)])))
            if extra:
                known.append(size)
                rows.append((len(rows), " ".join(words[: size - extra])))
    sets = word_sets(rows, 3)
    parent = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if known[i] == known[j] and parent[i] != parent[j]:
                a, b = sets[rows[i][0]], sets[rows[j][0]]
                if len(a & b) * 180 >= 80 * (len(a) + len(b)):
                    old, least = max(parent[i], parent[j]), min(parent[i], parent[j])
                    parent = [least if p == old else p for p in parent]
    got = ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 3, 80).collect()
    assert {r.doc_id: r.component_id for r in got} == dict(enumerate(parent))


def test_components(spark):
    edges = [(i, i + 1) for i in range(50)] + [(10_000 + (i * 7919) % 4001, 10_000 + ((i + 1) * 7919) % 4001) for i in range(4000)] + [(100, 200), (200, 300), (7, 7), (300, 100)]
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(51)} | {10_000 + i: 10_000 for i in range(4001)} | {100: 100, 200: 100, 300: 100}


def segmentation_odds(text, vocab):
    """Every segmentation of a text (as pieces) with its probability, by enumeration."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=piece_sampling.MODEL)
    pieces = {sp.id_to_piece(i): i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i))}
    found = {}

    def walk(rest, ids, weight):
        if not rest:
            found[tuple(ids)] = weight
        for n in range(1, len(rest) + 1):
            if rest[:n] in pieces:
                walk(rest[n:], [*ids, pieces[rest[:n]]], weight * float(np.exp(vocab.weight[pieces[rest[:n]]])))

    walk("▁" + text, [], 1.0)
    total = sum(found.values())
    return {k: v / total for k, v in found.items()}


@pytest.mark.parametrize("long_unit", [256, 1])
def test_drawn_segmentations_have_their_probabilities(long_unit, monkeypatch):
    monkeypatch.setattr(piece_sampling, "LONG_UNIT", long_unit)
    monkeypatch.setattr(piece_sampling, "BLOCK", 3)
    vocab, n = piece_sampling.load_vocabulary(), 4000
    odds = segmentation_odds("there", vocab)
    sizes, ids = piece_sampling.encode_batch(["there"] * n, np.arange(n).astype(np.uint64), vocab)
    seen = collections.Counter(tuple(x.tolist()) for x in np.split(ids, np.cumsum(sizes)[:-1]))
    assert set(seen) <= set(odds) and len(odds) > 5
    for k, p in odds.items():
        assert abs(seen[k] - n * p) < 5 * np.sqrt(n * p * (1 - p)) + 1


def test_long_units_are_not_cut(monkeypatch):
    vocab = piece_sampling.load_vocabulary()
    words = "unbreakablelongidentifier" * 40
    texts = [words, "x " * 30 + words + " y", "日本語" * 300]
    sizes, ids = piece_sampling.encode_batch(texts * 30, np.arange(90).astype(np.uint64), vocab)
    assert [b.decode() for b in piece_sampling.decode_batch(sizes, ids, vocab)] == texts * 30
    crossed = set()
    for x in np.split(ids, np.cumsum(sizes)[:-1])[::3]:
        end = np.cumsum(vocab.piece_size[x]) - 1  # without the mark
        crossed |= {k for k in range(64, len(words), 64) if k not in end.tolist()}
    assert len(crossed) >= 10  # of 15 positions, some at which no piece of the vocabulary crosses
    monkeypatch.setattr(piece_sampling, "CHUNK_CHARS", 50)
    parts = piece_sampling.encode_batch(texts * 30, np.arange(90).astype(np.uint64), vocab)
    assert parts[0].tolist() == sizes.tolist() and parts[1].tolist() == ids.tolist()


def test_exact_dedup_keeps_one_of_repeated_rows(spark):
    rows = [(1, "a b", "en"), (1, "a b", "en"), (2, "ab", "en"), (1, "x", "en"), (3, "x y", "en"), (None, "q", None), (None, "q", None), (4, None, "en"), (4, None, "en")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").selectExpr("*", "1 AS n", "'c' AS sha", "2 AS row", "3 AS id", "4 AS k", "5 AS w")
    for tracked, top in ((64, 4), (64, 1)):
        left = exact_dedup.drop_duplicates(df, tracked, top)
        assert left.columns == df.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in left.collect()) == [("1", "a b"), ("1", "x"), ("3", "x y"), ("4", "None"), ("None", "q")]
    many = spark.createDataFrame([(7, "same text", "en")] * 500 + [(i, f"t {i % 50}", "en") for i in range(300)], "doc_id long, text string, lang string").repartition(4)
    assert exact_dedup.drop_duplicates(many, 64, 4).count() == 51


def test_near_duplicates_keep_one_of_repeated_rows(spark):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " z"), (3, "short one"), (3, "short one"), (3, "another text here"), (None, text), (None, text), (5, ""), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS rows", "2 AS component_id", "3 AS n")
    left = ngram_join.keep_one_of_each(df)
    assert left.columns == df.columns
    assert sorted((str(r.doc_id), r.text) for r in left.collect()) == sorted([("1", text), ("3", "another text here"), ("3", "short one"), ("None", text), ("None", text), ("5", "")])


def test_near_duplicates_lose_no_text_of_a_doc_id_with_several(spark):
    a, b = (" ".join(f"{k}{i}" for i in range(60)) for k in "ab")
    rows = [(1, a), (5, a), (5, b), (7, b + " more"), (9, "quite another text of some words"), (7, a + " more"), (5, b + " x"), (5, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS said", "2 AS part", "3 AS class").repartition(3)
    left = ngram_join.keep_one_of_each(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text) for r in left.collect()) == [(1, a), (5, ""), (5, b), (9, rows[4][1])]
    got = sorted((r.doc_id, r.component_id) for r in ngram_join.similar_groups(df).collect())
    assert got == [(1, 1), (5, 1), (5, 5), (5, 5), (5, 5), (7, 1), (7, 5), (9, 9)]


@pytest.mark.parametrize("percent", [0, 30, 50, 101])
def test_ngram_join_refuses_similarities_that_it_cannot_find(spark, percent):
    with pytest.raises(ValueError, match="percent"):
        ngram_join.similar_groups(spark.createDataFrame([(1, "x y"), (2, "x")], "doc_id long, text string"), 1, percent)


def test_ngram_join_just_above_a_half(spark):
    rows = [(1, "x y"), (2, "x y z"), (3, "x"), (4, "p q r s t"), (5, "p q r"), (6, "p q")]
    got = {r.doc_id: r.component_id for r in ngram_join.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), 1, 51).collect()}
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 4, 6: 4}


def test_visits_of_many_blocks_come_in_small_batches():
    rng = np.random.default_rng(1)
    cells, n, d = 200, 10_000, 64
    centre, q = rng.normal(size=(cells, d)), rng.normal(size=(n, d))
    batch = pa.record_batch([pa.array(np.arange(n)), pa.array(np.zeros(n, np.int32)), pa.array(list(q)), pa.array(np.full(n, -np.inf))], ["s", "b", "q", "carried"])
    run = collision_search.other_blocks(centre, np.ones(cells), np.full(cells, 20.0), np.ones(cells, np.int64), np.ones(cells, np.int64))
    found = list(run(iter([batch])))
    assert sum(b.num_rows for b in found) == n * (cells - 1) and max(b.nbytes for b in found) < 50e6


def test_every_kernel_from_the_floor_on_is_found():
    rng = random.Random(1)
    marks = ["^" + "".join(rng.choice("abcdefghijklmnoprstu") for _ in range(rng.randint(2, 9))) for _ in range(60)] + ["^aaaa", "^abcdefghijklmnopq"]
    words = ["^" + "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 9))) for _ in range(200)]
    for m in marks * 20:
        w = list(m[1:])
        for _ in range(rng.randint(0, 3)):
            w.insert(rng.randrange(len(w) + 1), rng.choice("abxyz")) if rng.random() < 0.5 or len(w) < 3 else w.pop(rng.randrange(len(w)))
        words.append("^" + "".join(w))
    own, mine = toxicity.self_kernel(marks), toxicity.self_kernel(words)
    full = np.stack([toxicity.raw_kernel(toxicity.pad(words), toxicity.pad([m] * len(words))) / np.sqrt(np.maximum(mine * own[j], 1e-12)) for j, m in enumerate(marks)], 1)
    full[full < toxicity.FLOOR] = 0
    found = toxicity.kernels(words, marks, own)
    near = np.abs(full - toxicity.FLOOR) < 1e-4
    assert (full > 0).sum() > 400 and np.abs(full - found)[~near].max() < 1e-4


def test_sample_reaches_every_stratum(spark):
    df = spark.range(7000).selectExpr("id AS doc_id", "concat('l', id % 70) AS lang")
    got = batches.seeded_sample(df, df["doc_id"], df["lang"], 20, 3).groupBy("lang").count().collect()
    assert len(got) == 70 and all(5 <= r["count"] <= 45 for r in got)
    assert batches.seeded_sample(df, df["doc_id"], df["lang"], 100, 3, most_rows=700).count() < 1000


def test_foreign_and_garbled_texts_are_rejected(spark):
    rng = random.Random(4)
    words = {"en": "the cat and dog of it with every other house".split(), "de": "der hund und die maus ist nicht ohne haus weg".split()}
    text = lambda k, n=60: " ".join(rng.choice(words[k]) for _ in range(n))
    rows = [(i, text(("en", "de")[i % 2]), ("en", "de")[i % 2]) for i in range(400)]
    net = language_id.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 120, epochs=6, reject=True)
    odd = ["".join(rng.sample(text("en", 90), 300)) for _ in range(20)] + ["zqx vkpw jjzx qwv " * 20, "\u0436\u0448\u0449 \u044b\u044d\u044e " * 40]
    clean = [text("en"), text("de"), "the cat", "der hund"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(clean + odd + [None, "", "12 34"])], "doc_id long, text string").selectExpr("*", "1 AS lang_pred", "2 AS score")
    left = language_id.keep_identified(df, net)
    kept = {r.doc_id for r in left.collect()}
    assert left.columns == df.columns and set(range(4)) <= kept and len(kept) <= 6


def test_piece_sampling(spark, docs, empty):
    vocab = piece_sampling.load_vocabulary()
    texts = ["hello world", "", "  two  spaces\n\nnew\tline ▁ mark ▁▁x", "Éàü 日本語 🙂 " + "a" * 300, None, " lead", "▁", "\0"]
    keys = np.arange(len(texts)).astype(np.uint64)
    sizes, ids = piece_sampling.encode_batch(texts, keys, vocab)
    assert [b.decode() for b in piece_sampling.decode_batch(sizes, ids, vocab)] == [t or "" for t in texts]
    alone = [piece_sampling.encode_batch([t], keys[i : i + 1], vocab)[1].tolist() for i, t in enumerate(texts)]
    assert sum(alone, []) == ids.tolist()
    many, _ = piece_sampling.encode_batch(["there"] * 500, np.arange(500).astype(np.uint64), vocab)
    assert len(set(many.tolist())) > 1
    out = piece_sampling.encode(docs, vocab)
    assert out.where("NOT lossless").count() == 0 and out.count() == docs.count()
    back = {r.doc_id: r.text for r in piece_sampling.decode(out, vocab).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}
    assert piece_sampling.encode(empty, vocab).count() == 0
