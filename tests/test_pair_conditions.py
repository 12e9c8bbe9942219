from dutyweave.operators import phrases


def test_no_join_passes_words_through_the_driver(spark):
    rows = [("f", "1", "red", True), ("f", "1", "bell", False), ("f", "1", "hot", False), ("f", "2", "red", True), ("f", "2", "hot", False), ("f", "2", "dry", True)]
    found = phrases.pair_conditions(spark.createDataFrame(rows, "family string, code string, word string, leaf boolean"))
    assert sorted(tuple(r) for r in found.collect()) == [("1", "bell", "red"), ("2", "dry", "hot")]
    joins = [line for line in found._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Join" in line]
    assert joins and all("strategy=merge" in line for line in joins)
