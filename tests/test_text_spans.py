from dutyweave.operators import facts


def test_only_lines_are_shuffled(spark):
    lines = spark.createDataFrame([(1, " red bell, hot (dry)"), (1, "red"), (2, ""), (2, None), (3, "a/b"), (1, "red"), (3, "a/b c")], "doc_id long, line string")
    found = facts.text_spans(lines)
    got = sorted((r.doc_id, r.span) for r in found.collect())
    assert got == sorted([(1, s) for s in ("red bell, hot (dry)", "red bell", "hot", "dry", "red", "bell,", "(dry)")] + [(3, s) for s in ("a/b", "a", "b", "a/b c", "b c", "c")])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate") < plan.index("Aggregate") and plan.count("Aggregate") == 1  # spans come after the only shuffle
