"""Alignment, packing and hard negatives against brute force on small fixtures, and their defined results for odd input."""

import collections
import hashlib
import math
import random
import zlib

import numpy as np
import pytest

from dutyweave.llm import chunk_tokens, hard_negatives, packing, token_alignment

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [
    None, "", " ", "a  b <|endoftext|> x\n\n y", "\n x", " x", "x ", "a \n b c d", "<|endoftext|>", "don't  won't 's I'm", "\x1c a \x1d", " \x85 x \xa0 y", "日本語 \U0001f600 é'll",
    "a ▁ b", "<s> <0x41> </s>", "x" * 3000, " " * 300, "ab\n" * 2000, "tie tie tie",
]


def texts(seed=3, n=60):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeéß,.") for _ in range(rng.randint(1, 8))) for _ in range(400)]
    return [" ".join(rng.choice(words) for _ in range(rng.choice([3, 40, 200, 900]))) for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    found = [(i, t, None, None, None) for i, t in enumerate([*texts(), *ODD])]
    return [*found, found[5], found[5], (None, "no id", None, None, None), (5, "same id", None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3).selectExpr("*", "1 AS row", "'clash' AS pairs", "2 AS length", "3 AS ids", "4 AS _row")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return lambda as_text: (t := Tokenizer.from_file(chunk_tokens.path("byte_bpe_50k.json")), setattr(t, "encode_special_tokens", as_text))[0]


def aligned(text, a_tok, b_tok, a_bytes):
    """Groups of ids, and linked pairs, token by token."""
    a, b = a_tok.encode(" " + (text or ""), add_special_tokens=False).ids, b_tok.encode(text or "")
    b_bytes = [bytes([int(p[3:-1], 16)]) if b_tok.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [b_tok.id_to_piece(i)]]
    said = (" " + (text or "")).encode()
    if not text or b"".join(a_bytes[i] for i in a) != said or b"".join(b_bytes) != said:
        return [], [], [], []
    a_end, b_end = np.cumsum([len(a_bytes[i]) for i in a]).tolist(), np.cumsum([len(x) for x in b_bytes]).tolist()
    at, groups, links, x, y = {e: k for k, e in enumerate(b_end)}, [], [], 0, 0
    for k, e in enumerate(a_end):
        if e in at:
            groups.append(",".join(map(str, a[x : k + 1])) + "|" + ",".join(map(str, b[y : at[e] + 1])))
            links.append((a[k], b[at[e]]))
            x, y = k + 1, at[e] + 1
    return a, b, groups, links


@pytest.mark.parametrize("hot_pairs, most, slice_", [(1 << 20, 10**6, 1 << 18), (7, 50, 64)])
def test_alignment(spark, docs, rows, tokenizer, hot_pairs, most, slice_, monkeypatch):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=chunk_tokens.path("piece_bpe_32k.model"))
    own = token_alignment.Aligner(token_alignment.BYTE_TOKENS, token_alignment.PIECES)
    want = [(i, aligned(t, tokenizer(True), sp, own.a_bytes)) for i, t, *_ in rows]
    count = collections.Counter(pair for _, w in want for pair in w[3])
    most_of = {b: max(n for (_, y), n in count.items() if y == b) for _, b in count}
    expected = sorted(
        (
            (i is None, i or 0, len(a), len(b), len(g), len(x), sum(count[p] == most_of[p[1]] for p in x), sum(count[p] for p in x), hashlib.sha256(";".join(g).encode()).hexdigest() if g else "", ";".join(g))
            for i, (a, b, g, x) in want
        ),
    )
    found = token_alignment.align(docs, with_groups=True, hot_pairs=hot_pairs).collect()
    got = sorted((r.doc_id is None, r.doc_id or 0, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256, r.groups) for r in found)
    assert got == expected
    if hot_pairs < 100:  # the same texts in many small slices, with a store that starts anew
        monkeypatch.setattr(own.store, "most", most)
        monkeypatch.setattr(token_alignment, "slices", lambda r: chunk_tokens.slices(r, slice_))
        for k in range(0, len(rows), 9):
            some = own.align([t for _, t, *_ in rows[k : k + 9]], True)
            assert some["groups"] == [";".join(w[2]) for _, w in want[k : k + 9]]
            assert some["groups_sha256"] == [hashlib.sha256(";".join(w[2]).encode()).hexdigest() if w[2] else "" for _, w in want[k : k + 9]]


def test_alignment_of_an_empty_table(spark):
    found = token_alignment.align(spark.createDataFrame([], SCHEMA))
    assert found.count() == 0 and found.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def test_gallop_finds_every_place():
    rng = np.random.default_rng(5)
    for _ in range(200):
        longer = np.sort(rng.choice(500, rng.integers(1, 200), replace=False))
        driver = np.sort(rng.choice(520, rng.integers(1, 100), replace=False))
        low, high = np.zeros(len(driver), np.int64), np.full(len(driver), len(longer))
        guess = rng.integers(0, len(longer), len(driver))
        assert (token_alignment.gallop(driver, low, high, longer, guess) == np.searchsorted(longer, driver)).all()


def test_overlap_ranges_are_the_tokens_that_share_a_byte():
    rng = np.random.default_rng(6)
    for _ in range(100):
        a, b = (np.append(np.sort(rng.choice(np.arange(1, 60), rng.integers(1, 30), replace=False)), 60) for _ in range(2))
        first, last = token_alignment.overlap_ranges(a, b)
        for k, (x, y) in enumerate(zip(np.append(0, a[:-1]), a)):
            shared = [j for j, (p, q) in enumerate(zip(np.append(0, b[:-1]), b)) if max(x, p) < min(y, q)]
            assert (first[k], last[k]) == (shared[0], shared[-1])


@pytest.mark.parametrize("most", [1 << 17, 20])
def test_packing(spark, docs, rows, tokenizer, most):
    capacity = 128
    want = []
    for i, t, *_ in rows:
        ids = [*tokenizer(False).encode(t or "", add_special_tokens=False).ids, packing.END]
        first = (len(ids) - 1) % capacity + 1
        cut = [ids[:first], *(ids[a : a + capacity] for a in range(first, len(ids), capacity))]
        starts = np.cumsum([0, *map(len, cut)]).tolist()
        want += [(i is None, i or 0, k, starts[k], len(c), zlib.crc32(np.array(c, "<u4").tobytes())) for k, c in enumerate(cut)]
    cut = packing.pieces(docs, capacity=capacity, with_ids=True)
    found = packing.pack(cut, capacity, most)
    got = found.collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.piece, r.start, r.length, r.ids_crc32) for r in got) == sorted(want)
    held = collections.defaultdict(list)
    for r in got:
        held[r.sequence_id].append((r.offset, r.length))
    for parts in held.values():
        ends = np.cumsum([n for _, n in sorted(parts)])
        assert [o for o, _ in sorted(parts)] == [0, *ends[:-1]] and ends[-1] <= capacity
    assert len(held) <= 1.1 * math.ceil(sum(w[4] for w in want) / capacity)
    whole = {r.sequence_id: r.ids for r in packing.sequences(found).collect()}
    assert all(zlib.crc32(np.array(whole[r.sequence_id][r.offset : r.offset + r.length], "<u4").tobytes()) == r.ids_crc32 for r in got)


def test_packing_of_empty_tables_and_one_length(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], SCHEMA))).count() == 0
    only = spark.createDataFrame([(k, None, None, None, None) for k in range(3000)], SCHEMA)  # an end mark each
    got = packing.pack(packing.pieces(only)).collect()
    assert len({r.sequence_id for r in got}) == 3 and len({(r.sequence_id, r.offset) for r in got}) == 3000


def test_a_piece_goes_where_the_squares_sum_to_the_least():
    rng = random.Random(8)
    for _ in range(30):
        capacity = rng.randint(5, 30)
        lengths = [rng.randint(1, capacity - 1) for _ in range(60)]
        gaps, want = [], []
        for n in lengths:
            def squares(k):
                after = [g - n if j == k else g for j, g in enumerate(gaps)] + ([capacity - n] if k == len(gaps) else [])
                return sum(v * v for g, v in collections.Counter(after).items() if g > 0)

            may = [k for k in range(len(gaps) + 1) if k == len(gaps) or gaps[k] >= n]
            k = min(may, key=lambda k: (squares(k), gaps[k] if k < len(gaps) else capacity))
            gap = gaps[k] if k < len(gaps) else capacity
            want.append(gap)
            gaps = gaps + [capacity - n] if k == len(gaps) else [g - n if j == k else g for j, g in enumerate(gaps)]
        packed = packing.place_all(iter(lengths), capacity)
        assert sorted(capacity - sum(p) for p in packed) == sorted(gaps)


def test_the_plan_of_many_equal_parts_uses_every_piece_once():
    counts = np.bincount(np.random.default_rng(2).integers(1, 100, 20_000), minlength=100) * 1_000_003
    slots = packing.plan(counts, 100, 1 << 14)
    total = int((np.arange(100) * counts).sum())
    assert slots["sequences"] <= 1.01 * total / 100
    for n in range(1, 100):  # ranks start at 0 and leave no gap
        mine = slots["rank"][slots["length"] == n]
        assert not counts[n] or mine[0] == 0 and mine[-1] < counts[n]


VECTORS = "vec_id long, embedding array<double>, label int, anchor int, g int"


def mined(rows, every, percent=80):
    def label(i, l):
        return (l + 1) % 10 if i % 7 == 0 else l

    def score(x, y):
        return sum(math.floor(256 * p) * math.floor(256 * q) if abs(p) < 2**40 and abs(q) < 2**40 else int(p) * 256 * int(q) * 256 for p, q in zip(x, y))

    use = [(i, v, label(i, l)) for i, v, l, *_ in rows if i is not None and l is not None and v and len(v) == 4 and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for a, v, l in {(i, tuple(v), l) for i, v, l in use if i % every == 0}:
        near = sorted((-score(v, w), i) for i, w, m in use if m == l and i != a)[:5]
        for s, p in near:
            hard = sorted((-score(v, w), i) for i, w, m in use if m != l and i != a and 80 * -s <= 100 * score(v, w) <= 100 * -s)[:5]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i) in enumerate(hard)]
    return sorted(out)


@pytest.mark.parametrize("scale, block_rows", [(0.5, (16, 40)), (1e5, (8, 8)), (0.5, (1024, 4096))])
def test_hard_negatives(spark, scale, block_rows):
    rng = random.Random(11)
    rows = [(i, [rng.choice([-1, -0.5, 0, 0.3, 0.7, 1]) * scale for _ in range(4)], rng.choice([0, 0, 0, 3, 9]), 1, 2) for i in range(150)]
    rows += [rows[10], rows[20], rows[20], (None, [1.0] * 4, 1, 1, 2), (151, None, 1, 1, 2), (152, [1.0] * 4, None, 1, 2), (153, [1.0, None, 1.0, 1.0], 1, 1, 2)]
    rows += [(154, [1.0, math.nan, 1.0, 1.0], 1, 1, 2), (155, [math.inf, 1.0, 1.0, 1.0], 1, 1, 2), (156, [1.0], 1, 1, 2), (160, [0.0] * 4, 0, 1, 2), (157, [], 1, 1, 2)]
    table = spark.createDataFrame(rows, VECTORS).repartition(3)
    got = hard_negatives.mine(table, anchor_every=10, block_rows=block_rows).collect()
    found = sorted((r.anchor_id, r.positive_id, r.rank, r.negative_id, r.positive_score, r.negative_score) for r in got)
    want = mined(rows, 10)
    assert len(want) > 100 and found == want


def test_hard_negatives_beyond_a_long_are_ranked_exactly(spark):
    rows = [(0, [1e30, 1.0], 1, 1, 2), (1, [1e30, 0.0], 1, 1, 2), (2, [9e29, 0.0], 2, 1, 2), (3, [1e300, 0.0], 2, 1, 2), (4, [8.5e29, 0.0], 2, 1, 2), (5, [1e29, 0.0], 2, 1, 2)]
    got = hard_negatives.mine(spark.createDataFrame(rows, VECTORS), relabel_every=1000).collect()
    assert {(r.anchor_id, r.positive_id, r.negative_id) for r in got} <= {(0, 1, 2), (0, 1, 4)}
    assert hard_negatives.mine(spark.createDataFrame([], VECTORS)).count() == 0


def test_packed_products_are_exact():
    rng = np.random.default_rng(9)
    for scale in (0.5, 40.0, 1e4, 1e7, 1e200):
        c, a = rng.normal(size=(37, 8)) * scale, rng.normal(size=(5, 8)) * scale
        want = [[sum(int(p) * int(q) for p, q in zip(x, y)) for y in hard_negatives.whole(c)] for x in hard_negatives.whole(a)]
        assert hard_negatives.Packed(c, a).scores(slice(0, 5)).tolist() == want
    assert hard_negatives.Packed(rng.normal(size=(9, 64)) / 8, rng.normal(size=(2, 64)) / 8).fields == 2


def test_encoding_holds_the_lattice_of_few_characters():
    import random
    import tracemalloc

    import numpy as np

    from dutyweave.llm import piece_sampling

    vocab, r = piece_sampling.load_vocabulary(), random.Random(1)
    texts = [" ".join("".join(r.choices("abcdefghij", k=8)) for _ in range(100)) for _ in range(1000)]
    keys = np.arange(len(texts)).astype(np.uint64)
    tracemalloc.start()
    sizes, ids = piece_sampling.encode_batch(texts, keys, vocab)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [b.decode() for b in piece_sampling.decode_batch(sizes, ids, vocab)] == texts
    assert peak < 100e6
