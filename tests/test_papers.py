"""Papers and votes with fixed expected rows."""

from pyspark.sql import functions as F

from dutyweave.operators import papers, votes


def test_sheet_with_heading_below_a_title_and_an_example_sheet(spark):
    sheet = [["Composition"], ["Product name", "Ingredient", "Content", "Origin"], ["Dough", "flour", "0.6", "KR"], ["", "", "0.1", ""], [None, "water", "0.4", ""], ["Filling", "cod", "", "NO"]]
    rows = [("f", "A", i, j, t) for i, line in enumerate(sheet) for j, t in enumerate(line)] + [("f", "작성 예시", i, 0, "Product name") for i in range(30)]
    got = papers.sheet_entries(spark.createDataFrame(rows, "form string, sheet string, line int, pos int, text string")).orderBy("order_index").collect()
    assert [tuple(r) for r in got] == [("f", 1, "Dough", "flour", 60.0, "KR"), ("f", 2, "Dough", "water", 40.0, ""), ("f", 3, "Filling", "cod", None, "NO")]


def test_unknown_kinds_are_read_as_food_and_empty_tables_give_no_rows(spark):
    rows = [("f", "A", 0, 0, "구분", "odd"), ("f", "A", 0, 1, "성분", "odd"), ("f", "A", 1, 1, "쌀", "odd"), ("g", "A", 0, 0, "CAS 64-17-5 99 %", "chemical")]
    cells = spark.createDataFrame(rows, "form string, sheet string, line int, pos int, text string, kind string")
    assert {(r.form, r.kind, r.ingredient, r.cas) for r in papers.read_papers(cells).collect()} == {("f", "food", "쌀", None), ("g", "chemical", None, "64-17-5")}
    assert papers.read_papers(cells.limit(0)).count() == 0


def test_events_are_added(spark, tmp_path):
    path = str(tmp_path / "ledger")
    for i in range(2):
        papers.append_events(spark.createDataFrame([(i, "x")], "id int, kind string"), path)
    assert sorted(r.id for r in spark.read.parquet(path).collect()) == [0, 1]


def test_a_syllable_pair_decides_the_main_ingredient(spark):
    c = spark.createDataFrame([(1, 1, "고춧가루"), (1, 2, "새꼬막"), (2, 1, "x")], "product int, pos int, name string")
    f = spark.createDataFrame([(1, "꼬막장"), (2, None)], "product int, text string")
    e = spark.createDataFrame([(1, "고춧가루", 40.0)], "product int, name string, percent double")
    assert {r.product: (r.principal, r.way) for r in votes.pick_principal(c, f, e).collect()} == {1: ("새꼬막", "identity"), 2: ("", "none")}


def test_names_to_look_up(spark):
    df = spark.createDataFrame([("[A] 국산 칼국수 2인분 (new) 500g x",), (None,)], "n string").select(votes.looked_up_names(F.col("n")).alias("n"))
    assert [r.n for r in df.collect()] == [["국산 칼국수", "칼국수"], [""]]


def test_cells_of_a_sheet_are_shuffled_once(spark):
    food = [("f", "A", 0, 0, "품명"), ("f", "A", 0, 1, "성분"), ("f", "A", 1, 1, "쌀"), ("f", "B", 0, 0, "구분"), ("f", "B", 0, 1, "Ingredient"), ("f", "B", 1, 1, "a"), ("f", "B", 2, 0, " "), ("f", "B", 2, 1, "b"), ("g", "A", 3, 0, "x"), (None, "A", 0, 1, "성분")]
    found = papers.sheet_entries(spark.createDataFrame(food, "form string, sheet string, line int, pos int, text string"))
    assert sorted((r.form, r.order_index, r.ingredient) for r in found.collect()) == [("f", 1, "a"), ("f", 2, "b")]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.split("Initial Plan")[-1].count("Exchange hashpartitioning") == 1
