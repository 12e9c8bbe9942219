"""Fixed rows for field binding, polarity, concepts, boxes, trees and layers."""

import pytest
from pyspark.sql import functions as F

from dutyweave.operators import binding, evaluate, hierarchy, layers, phrases, requirements, sheets
from dutyweave.plans import binding_queries as bq

TIERS = [
    ("product_identity", 0, "identity_hints", "identity"), ("species_source", 0, "composition_facts", "principal"), ("species_source", 1, "identity_hints", "guess"),
    ("preservation_state", 0, "composition_facts", "state"), ("preservation_state", 1, "identity_hints", "hint_state"), ("physical_form", 0, "identity_hints", "wrapper"), ("physical_form", 0, "identity_hints", "form"),
]


def bound(spark, axis, words, facts, flags=()):
    q = spark.createDataFrame([(1, axis, words)], "product int, axis string, words array<string>")
    f = spark.createDataFrame([(1, p, v) for p, v in facts], "product int, path string, value string")
    g = spark.createDataFrame([(1, p, v) for p, v in flags], "product int, path string, flag boolean")
    r = binding.bind_axis(q, f, g, spark.createDataFrame(TIERS, "axis string, tier int, lane string, path string"), spark.createDataFrame([("wrapper", "stuffed"), ("wrapper", "filled")], "path string, word string")).collect()[0]
    return r.status, r.tier, r.lane, r.tokens, r.denied


def test_axis_field_binding(spark):
    assert bound(spark, "product_identity", [], [("identity", "stuffed dumpling"), ("principal", "fish")]) == ("answered", 0, "identity_hints", "dumpling stuffed", "")
    assert bound(spark, "species_source", [], [("principal", "shrimp"), ("guess", "fish")])[:4] == ("answered", 0, "composition_facts", "shrimp")
    assert bound(spark, "species_source", [], [("guess", "cod fish")])[:4] == ("answered", 1, "identity_hints", "cod fish")
    assert bound(spark, "preservation_state", [], [("state", "unknown"), ("hint_state", "frozen")])[:4] == ("answered", 1, "identity_hints", "frozen")
    assert bound(spark, "preservation_state", [], [("state", "chilled"), ("hint_state", "frozen")])[:4] == ("answered", 0, "composition_facts", "chilled")
    assert bound(spark, "physical_form", ["stuffed"], [("form", "thick noodles")], [("wrapper", False)]) == ("answered", 0, "composition_facts", "", "filled stuffed")
    assert bound(spark, "physical_form", ["minced"], [("form", "minced")], [("wrapper", False)]) == ("answered", 0, "identity_hints", "minced", "")
    assert bound(spark, "technical_specification", ["power"], [("form", "minced")])[:2] == ("unsupported", -1)
    assert bound(spark, "species_source", [], [])[:4] == ("empty", 0, "composition_facts", "")


@pytest.mark.parametrize(("text", "kind"), bq.WORDINGS)
def test_polarity(spark, text, kind):
    assert spark.range(1).select(binding.polarity(F.lit(text), ["stuffed", "filled"]).alias("k")).first().k == kind


def test_boxes_are_held_against_kept_ones(spark):
    rows = [(1, 1, 0, 0, 10, 10, "a"), (1, 2, 0, 0, 14, 10, "b"), (1, 3, 0, 0, 20, 10, "c"), (1, 4, 90, 90, 99, 99, " a "), (1, 5, 50, 50, 60, 60, ""), (1, 6, 70, 70, 80, 80, None), (2, 1, 0, 0, 0, 0, ""), (2, 2, 0, 0, 0, 0, "")]
    df = spark.createDataFrame(rows, "page int, box_id int, x1 int, y1 int, x2 int, y2 int, text string")
    # 2 repeats 1; 3 repeats only 2, which is gone, so 3 stays; 4 has 1's text far away
    assert sorted((r.page, r.box_id) for r in evaluate.dedupe_boxes(df).collect()) == [(1, 1), (1, 3), (1, 5), (1, 6), (2, 1), (2, 2)]


def test_tree_of_any_depth_without_expired_rows(spark):
    rows = [("01", i, i, None) for i in range(14)] + [("01", 14, 13, "2020-01-01"), ("01", 15, 14, None)]
    got = {r.pos: r.parent_pos for r in hierarchy.build_tree(spark.createDataFrame(rows, "chapter string, pos long, depth int, end_date string")).collect()}
    assert got == {0: None} | {i: i - 1 for i in range(1, 14)} | {15: 13}
    chain = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(25)], "concept string, parent string")
    assert hierarchy.closure(chain).agg(F.max("distance")).first()[0] == 25


def test_missing_headings_and_routes(spark):
    b = spark.createDataFrame([("0101", True, "0101210000"), ("0102", False, "0102000000")], "heading string, leaf boolean, goods_code_10 string")
    h = spark.createDataFrame([("0101",), ("0102",), ("0999",)], "heading string")
    assert {r.heading: r.status for r in requirements.branch_status(h, b).collect()} == {"0101": "one_leaf", "0102": "non_declarable_only", "0999": "none"}
    f = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", "z")], "route string, fact string")
    assert {(r.route, r.other): (r.shared, r.jaccard) for r in evaluate.fact_agreement(f).collect()} == {("a", "b"): (1, 0.5), ("a", "c"): (0, 0.0), ("b", "c"): (0, 0.0)}


def test_priority_survives_reduction(spark):
    m = [(1, "0101210000", "103", "3 %"), (2, "0101000000", "103", "3 %"), (3, "0101000000", "103", "1 %"), (4, "0100000000", "103", "0 %"), (5, "0100000000", "103", "2 %"), (6, "0100000000", "103", "1 %")]
    measures = spark.createDataFrame(m, "measure_id long, goods_code_10 string, measure_type_code string, duty_text string")
    got = requirements.duty_priority(spark.createDataFrame([("0101210000",)], "code10 string"), measures, 3).orderBy("place").collect()
    assert [(r.measure_id, r.rate) for r in got] == [(4, 0.0), (3, 1.0), (5, 2.0)]


def test_empty_layers_and_phrases(spark):
    none = spark.createDataFrame([], "product int, code10 string, domains string")
    gates = spark.createDataFrame([], "gate_id int, runtime_gate boolean, chapter_scope string, domain_scope string, domain string, family string, type string, action string, priority int, title string")
    assert layers.match_pregate(none, gates).count() == 0
    units = lambda t: spark.range(1).select(phrases.phrase_units(F.lit(t), F.array(F.lit("fish"))).alias("u")).first().u
    assert units("Fish fillets, smoked or dried; L sections") == ["fillet", "smoked", "dried", "section", "l"] and units(None) == []
    roles = spark.createDataFrame([("", "water"), ("Dough", "flour"), ("", "beef stock"), ("", None), ("만두피", "밀가루"), ("김치소", "x"), ("비빔장", "x"), ("", "정제수"), ("", "멸치 육수"), ("", "간장 소스"), ("소금구이", "x")], "s string, i string").select(sheets.component_role(F.col("s"), F.col("i")).alias("r"))
    assert [r.r for r in roles.collect()] == ["solvent", "wrapper", "broth", "other", "wrapper", "filling", "sauce", "solvent", "broth", "sauce", "other"]


def test_what_is_left_open_is_not_denied(spark):
    labels = spark.createDataFrame(
        [(1, "Pasta, whether or not cooked"), (2, "Fish, whether or not smoked, such as eels, not frozen"), (3, "Boxes not weighing over"), (4, "Goods, not more than 3"), (5, "Pasta, not stuffed"), (6, "Not dried; whole, without bones")],
        "code int, label string",
    )
    got = sorted((r.code, r.kind, " ".join(r.words)) for r in phrases.exclusions(labels).collect())
    assert got == [(2, "exclusion", "frozen"), (3, "quantity", "over weighing"), (4, "quantity", "more than"), (5, "exclusion", "stuffed"), (6, "exclusion", "bone")]


def test_labels_led_by_a_marker_are_residual(spark):
    labels = ["Not elsewhere specified or included", "N.E.S. fish", "Other, of fish", "Fish, not elsewhere specified", "Otherwise made fish"]
    rows = [(k, "product_identity", v, "answered", ["fish"], [], [], []) for k, v in enumerate(labels)]
    df = spark.createDataFrame(rows, "row_id int, axis string, label string, status string, tokens array<string>, denied array<string>, first array<string>, accessory array<string>")
    assert [r.verdict for r in binding.axis_verdicts(df, [], []).orderBy("row_id").collect()] == ["resid", "resid", "resid", "O", "O"]
