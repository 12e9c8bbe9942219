"""Truth tables and rules with fixed expected rows."""

from pyspark.sql import functions as F

from dutyweave.functions import codes, duty, text
from dutyweave.operators import classify, evaluate, facts, ingest, hierarchy, hooks
from dutyweave.sources.pages import html_lines


def test_three_valued_roll_up(spark):
    cases = {
        "undecided": [[True, None], [None]],
        "confirmed": [[True, True]],
        "violated": [[False, None], [False, True]],
    }
    rows, want, p = [], {}, 0
    for decision, lists in cases.items():
        for values in lists:
            rows += [(p, i, v, "") for i, v in enumerate(values)]
            want[p] = decision
            p += 1
    rows += [(p, 0, False, "g"), (p, 1, None, "g"), (p + 1, 0, False, "g"), (p + 1, 1, True, "g"), (p + 2, 0, False, "g"), (p + 2, 1, False, "g")]
    want |= {p: "undecided", p + 1: "confirmed", p + 2: "violated"}
    df = spark.createDataFrame(rows, "product int, row_id int, verdict boolean, alt_group string")
    assert {r.product: r.decision for r in classify.roll_up(df, ["product"]).collect()} == want


def test_last_numeric_rule_has_losers_only_below_four_digits(spark):
    none = spark.createDataFrame([], "product int, code string")
    four = spark.createDataFrame([(1, "1902", False, "confirmed"), (1, "2104", False, "confirmed")], "product int, code string, residual boolean, decision string")
    six = four.withColumn("code", F.concat(F.lit("1902"), F.right("code", F.lit(2))))
    got4 = {r.code: (r.rule, r.wins, r.loses) for r in classify.general_rule_cascade(four, none, 4).collect()}
    got6 = {r.code: (r.rule, r.wins, r.loses) for r in classify.general_rule_cascade(six, none, 6).collect()}
    assert got4 == {"1902": ("gri3c_last_numeric", False, False), "2104": ("gri3c_last_numeric", True, False)}
    assert got6 == {"190202": ("gri6c_last_numeric", False, True), "190204": ("gri6c_last_numeric", True, False)}


def test_named_code_and_precedent_win(spark):
    ranked = spark.createDataFrame(
        [(1, "190211", False, "confirmed"), (1, "190219", True, "confirmed"), (2, "190211", False, "confirmed"), (2, "190219", False, "confirmed")],
        "product int, code string, residual boolean, decision string",
    )
    known = spark.createDataFrame([(2, "190219")], "product int, code string")
    won = {(r.product, r.rule): r.code for r in classify.general_rule_cascade(ranked, known, 6).where("wins").collect()}
    assert won == {(1, "gri6a_most_specific"): "190211", (2, "gri6_precedent"): "190219"}


def test_answer_overlay(spark):
    d = spark.createDataFrame([(1, None, "contains"), (2, None, "not_contains"), (3, None, "not_contains"), (4, None, "contains"), (5, False, "contains")], "question_key int, verdict boolean, op string")
    a = spark.createDataFrame([(1, "no", 1), (1, "yes", 2), (2, "yes", 1), (3, "no", 1), (4, "unknown", 1), (5, "yes", 1)], "question_key int, answer string, answered_at int")
    assert {r.question_key: r.verdict for r in classify.overlay_answers(d, a).collect()} == {1: True, 2: False, 3: True, 4: None, 5: False}


def test_stems_and_negation(spark):
    row = spark.range(1).select(
        text.tokens(F.lit("Molluscs, berries, boxes, glasses, whether or not cooked or otherwise prepared")).alias("t"),
        text.negated_tokens(F.lit("pasta, not stuffed; whether or not cooked; other than pencils of heading 9608")).alias("n"),
    ).first()
    assert set(row.t) == {"mollusc", "berry", "box", "glasse"} or set(row.t) == {"mollusc", "berry", "box", "glasses"}
    assert set(row.n) == {"stuffed"}


def test_duty_kinds(spark):
    want = {
        "": "blank", "NIHIL": "nihil", "9 %": "simple_percent", "12.8 % + 176.8 EUR/DTN": "compound_rate", "9 % + EA MAX 24.2 EUR/DTN": "min_max_rate",
        "KGM": "supplementary_unit", "Cond: B cert: C-644 (29): ; B (09):": "condition_expression", "9 % + EA": "agricultural_component", "176.8 EUR/DTN": "specific_rate", "see note": "unknown",
    }
    df = spark.createDataFrame([(k,) for k in want], "d string")
    assert {r.d: r.k for r in df.select("d", duty.duty_kind(F.col("d")).alias("k")).collect()} == want


def test_codes(spark):
    row = spark.range(1).select(
        codes.goods_code10(F.lit("1902 19 90")).alias("a"), codes.goods_code10(F.lit("123")).alias("b"), codes.padded10(F.lit("902199010")).alias("c"), codes.even_digits(F.lit("902")).alias("d"),
        codes.ancestors(F.lit("1902199010")).alias("e"),
    ).first()
    assert (row.a, row.b, row.c, row.d) == ("1902199000", None, "0902199010", "0902")
    assert row.e == ["1902199010", "1902199000", "1902190000", "1902000000", "1900000000"]


def test_html_lines():
    page = "<html><style>x{}</style><p>One  <b>two</b></p><script>var t='</p>'</script><ul><li>A &amp; B</li><li></li></ul>tail<noscript>no</noscript>"
    assert html_lines(page) == ["One two", "A & B", "tail"]
    assert html_lines(None) == [] == html_lines("")


def test_closure_and_most_specific(spark):
    e = spark.createDataFrame([("octopus", "cephalopod"), ("cephalopod", "mollusc"), ("mollusc", "aquatic"), ("shrimp", "crustacean"), ("crustacean", "aquatic")], "concept string, parent string")
    c = hierarchy.closure(e)
    assert {r.ancestor for r in c.where("concept = 'octopus'").collect()} == {"octopus", "cephalopod", "mollusc", "aquatic"}
    f = spark.createDataFrame([(1, "octopus"), (1, "mollusc"), (1, "shrimp")], "subject int, concept string")
    assert {r.concept for r in hierarchy.most_specific(f, c).collect()} == {"octopus", "shrimp"}


def test_loading(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text('a,b\n1,"x, y"\n,z\n')
    assert [tuple(r) for r in ingest.load_text_table(spark, str(p), ["a", "b"]).collect()] == [("1", "x, y"), ("", "z")]
    s = spark.createDataFrame([(" x ", "", "q")], "a string, b string, old string")
    assert tuple(ingest.load_common_columns(s, ["a", "b", "new", "gone"], {"old": "new"}).first()) == ("x", None, "q", None)


def test_hooks(spark):
    t = spark.createDataFrame([(1, "ab"), (2, None)], "id long, text string")
    assert {r.id: list(r.vector) for r in hooks.embed(t, lambda xs: [[float(len(x))] for x in xs]).collect()} == {1: [2.0], 2: [0.0]}
    q = t.withColumnRenamed("text", "prompt")
    assert {r.id: r.answer for r in hooks.ask(q, lambda xs: [x.upper() for x in xs]).collect()} == {1: "AB", 2: ""}
    cache = spark.createDataFrame([("é", "e")], "name string, translation string")
    names = spark.createDataFrame([("é",), ("ü",), ("plain",)], "name string")
    assert {r.name: r.translation for r in hooks.translate_missing(names, cache, lambda xs: ["?"] * len(xs)).collect()} == {"é": "e", "ü": "?"}


def test_row_order_and_partitions_change_nothing(spark):
    rows = [(p, f"i{k}", k, None if k % 3 else 20.0 * k) for p in range(40) for k in range(1, 6)]
    df = spark.createDataFrame(rows, "product int, name string, pos int, percent double")
    a = facts.principal_candidates(df).collect()
    b = facts.principal_candidates(df.orderBy(F.rand(3)).repartition(7)).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b))


def test_union_of_inputs_is_union_of_results(spark):
    rows = [(t, f"c{(t * 3 + k) % 4}") for t in range(20) for k in range(5)]
    df = spark.createDataFrame(rows, "table_id int, cell string")
    other = df.withColumn("cell", F.when(F.col("table_id") % 2 == 0, F.col("cell")).otherwise("c0"))
    whole = evaluate.table_agreement(df, other).collect()
    parts = [r for k in (0, 1) for r in evaluate.table_agreement(df.where(f"table_id % 2 = {k}"), other.where(f"table_id % 2 = {k}")).collect()]
    assert sorted(map(tuple, whole)) == sorted(map(tuple, parts))


def test_bridge_terms_takes_contained_keys_of_any_length(spark):
    keys = {"ab": "1", "pepper": "2", "xpepperpowder": "3", "peppercornsandmustardseeds": "4", "q": "5", "whole name": "6"}
    names = ["zzabzz", "hotxpepperpowderx", "a-peppercornsandmustardseeds-b", "1q1", "hot pepper", "whole name", "", "p"]
    standard = spark.createDataFrame(list(keys.items()), "key string, code10 string")
    entries = spark.createDataFrame(list(enumerate(names)), "entry_id long, name string")
    want = {}
    for i, name in enumerate(names):
        parts = [k for k in name.split() if k in keys]
        inner = [k for k in keys if len(k) >= 2 and k in name]
        key, tier = (name, 1) if name in keys else (max(parts, key=len), 2) if parts else (max(inner, key=len), 3) if inner else (None, 0)
        want[i] = (key, keys.get(key), tier)
    assert want[2] == ("peppercornsandmustardseeds", "4", 3) and want[0] == ("ab", "1", 3)
    assert {r.entry_id: (r.key, r.code10, r.tier) for r in facts.bridge_terms(entries, standard).collect()} == want
    assert [r.tier for r in facts.bridge_terms(entries, standard.limit(0)).collect()] == [0] * len(names)
