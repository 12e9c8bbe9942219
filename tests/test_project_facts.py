"""Listed facts of products: their order, and how they are shuffled and sorted."""

from dutyweave.operators import binding
from dutyweave.plans import catalogue


def test_entries_of_a_path_are_sorted_once_in_every_partition(spark):
    """Usable entries pass one sort, in partitions that are not merged; of entries at one place the smaller value comes first."""
    entries = [("p", "names", 1, v, None) for v in ("d", "b", "c", " N/A", None)] + [("p", "names", 0, "z", None), ("p", "sauce", 3, "x", True), ("p", "sauce", 2, "y", False), ("q", "other", 1, "a", None)]
    found = binding.project_facts(spark.createDataFrame(entries, "product string, path string, pos int, value string, flag boolean"), ["names", "sauce"], most=3)
    assert sorted((r.path, r.place, r.value) for r in found.collect()) == [("names", 1, "z"), ("names", 2, "b"), ("names", 3, "c"), ("sauce", 1, "x")]
    plan = found._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert plan.count("- Sort [") == 1 and plan.count("REPARTITION_BY_NUM") == 1 and plan.count("Exchange") == 1


def test_query_of_projected_facts_sorts_once(spark):
    plan = catalogue.queries()["project_facts"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("- Sort [") == 1 and plan.count("Exchange") == 1
