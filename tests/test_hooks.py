from pyspark.sql import functions as F

from dutyweave.operators import hooks


def test_cosine_top_k_by_blocks_equals_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(hooks, "BLOCK_ROWS", 7)
    monkeypatch.setattr(hooks, "QUERY_ROWS", 3)
    monkeypatch.setattr(hooks, "TILE", 5)
    rows = [(i, [float((i * 7 + j * j * (i % 5)) % 11 - 5) + (j == 0) / 8 for j in range(4)], i % 2) for i in range(40)]
    rows += [(50 + i, rows[4][1], 0) for i in range(9)]  # copies tie, the smaller vec_id first
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = {(r.query_id, r.place): (r.vec_id, r.score) for r in hooks.cosine_top_k(table.where("vec_id % 4 = 0"), table).collect()}

    def cosine(a, b):
        return round(sum(x * y for x, y in zip(a, b)) / sum(x * x for x in a) ** 0.5 / sum(x * x for x in b) ** 0.5, 6)

    want = {}
    for i, v, label in rows:
        if i % 4 == 0:
            best = sorted((-cosine(v, w), j) for j, w, other in rows if j != i and other == label)[:5]
            want.update({(i, n + 1): (j, -s) for n, (s, j) in enumerate(best)})
    assert got == want


def test_cosine_top_k_with_vectors_that_have_no_score(spark):
    rows = [(0, [1.0, 0.0], 1), (1, None, 1), (2, [0.0, 0.0], 1), (3, [2.0, 0.0], 1), (4, [1.0, None], 1), (5, [1.0, 0.0], None), (6, [1.0], 1)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    got = hooks.cosine_top_k(table.where("vec_id = 0"), table).orderBy("place").select("vec_id", F.col("score").cast("string")).collect()
    assert [tuple(r) for r in got] == [(2, "NaN"), (3, "1.0"), (1, None), (4, None), (6, None)]
    assert hooks.cosine_top_k(table.limit(0), table).count() == 0
