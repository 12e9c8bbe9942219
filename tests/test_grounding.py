"""Cells of read tables against all regions of their page; alternatives and ingredient lists on fixed rows."""

import random
import re
from difflib import SequenceMatcher

from dutyweave.operators import alternatives, evidence, fact_lines, grounding

UNITS = {"g", "kg", "mg", "l", "ml", "kcal"}


def plain(t):
    return "".join(c for c in (t or "").lower() if c.isalnum())


def words(t):
    return {w for w in re.findall(r"[a-z]+|[가-힣]+", (t or "").lower()) if w not in UNITS}


def numbers(t):
    return {f"{v.replace(',', '')}:{u or '#'}" for v, u in re.findall(r"(?<!\d)(\d+(?:[.,]\d+)?)\s*(mg|g|kg|ml|l|%|kcal)?", (t or "").lower())}


def supported(word, text):
    if len(word) <= 2:
        return word in words(text)
    return word in plain(text) or any(SequenceMatcher(None, word, w, autojunk=False).ratio() >= 0.8 for w in words(text))


def judged(text, regions):
    p, met = plain(text), []
    for t in regions:
        q = plain(t)
        if not q or not p:
            continue
        m = SequenceMatcher(None, p, q, autojunk=False)
        score = max(m.ratio(), m.find_longest_match().size / min(len(p), len(q)))
        evidence = bool(numbers(text) & numbers(t)) or any(supported(w, t) for w in words(text) if len(w) >= 2)
        if evidence or len(p) > 3 and (p in q or q in p or score >= 0.72):
            met.append(t)
    seen = set()
    for t in met:
        for b in SequenceMatcher(None, p, plain(t), autojunk=False).get_matching_blocks():
            if b.size >= (1 if len(p) <= 3 else 2):
                seen |= set(range(b.a, b.a + b.size))
    coverage = round(len(seen) / len(p), 4) if p else 0.0
    no_words = sorted(w for w in words(text) if not any(supported(w, t) for t in met))
    no_numbers = sorted(numbers(text) - {n for t in met for n in numbers(t)})
    return len(met), coverage, no_words, no_numbers, bool(met) and coverage >= 0.72 and not no_words and not no_numbers


def test_cells_are_judged_as_against_all_regions(spark):
    rng = random.Random(2)
    base = ["sodium 120 mg", "protein 3.5 g", "rice flour", "나트륨 120mg", "탄수화물 30 %", "fat", "1,200 kcal", "net weight 500g", "ok", "soybean oil (imported)", "x y", "7"]

    def noisy(t):
        for _ in range(rng.randint(0, 3)):
            i = rng.randrange(len(t) + 1)
            t = rng.choice([t[:i] + rng.choice("aeo1 나") + t[i:], t[:i] + t[i + 1 :], t[: max(1, i)]]) or "z"
        return t

    regions = [(p, k, noisy(rng.choice(base))) for p in range(6) for k in range(9)] + [(1, 90, None), (2, 91, "--"), (3, 92, "fat"), (3, 93, "fat")]
    cells = [(p, 1 + k // 6, k // 2, k % 2, noisy(rng.choice(base))) for p in range(7) for k in range(12)] + [(0, 9, 0, 0, " "), (0, 9, 1, 0, None), (0, 9, 2, 0, "!?")]
    c = spark.createDataFrame(cells, "page long, table_no int, row_no int, cell_no int, text string")
    found = grounding.ground_cells(c, spark.createDataFrame(regions, "page long, region int, text string"))
    got = {(r.page, r.table_no, r.row_no, r.cell_no): (r.matches, r.coverage, r.missing_words, r.missing_numbers, r.grounded) for r in found.collect()}
    want = {k[:4]: judged(k[4], [t for p, _, t in regions if p == k[0]]) for k in cells if (k[4] or "").strip()}
    assert got == want and 3 < sum(w[4] for w in want.values()) < len(want) - 3
    tables = {(r.page, r.table_no): (r.rows, r.grounded_rows, r.status) for r in grounding.ground_tables(c, found).collect()}
    for (page, table), (rows, good, status) in tables.items():
        mine = {k[2] for k in cells if k[:2] == (page, table)}
        ok = [n for n in mine if (v := [w[4] for k, w in want.items() if k[:3] == (page, table, n)]) and all(v)]
        assert (rows, good) == (len(mine), len(ok)) and status == ("grounded" if rows == good else "partial" if good else "rejected")


def test_alternatives_of_labels(spark):
    labels = [
        (1, "Fruit and nuts, uncooked or cooked by steaming or boiling in water, frozen"), (2, "Vegetables (uncooked or cooked by steaming), frozen"), (3, "Bread, pastry; communion wafers, rice paper"),
        (4, "Yogurt, whether or not concentrated, or containing nuts or cocoa"), (5, "Pasta, whether or not cooked or stuffed, such as spaghetti or noodles"), (6, "Fish (fresh), dried"), (7, None), (8, ""), (9, "Meat ; fresh or chilled"),
    ]
    atoms = alternatives.alternation_atoms(spark.createDataFrame(labels, "code int, label string"))
    got = {}
    for r in atoms.orderBy("code", "place").collect():
        got.setdefault(r.code, []).append((r.grp, r.atom))
    assert got == {
        1: [("g0", "uncooked"), ("g0", "cooked by steaming"), ("g0", "boiling in water")], 2: [("g0", "uncooked"), ("g0", "cooked by steaming")], 3: [("s0", "bread, pastry"), ("s0", "communion wafers, rice paper")],
        5: [("g0", "such as spaghetti"), ("g0", "noodles")], 9: [("g0", "fresh"), ("g0", "chilled")],
    }
    values = [(1, 1, "steaming"), (1, 2, "Water boiling"), (1, 3, "frozen"), (2, 1, "uncooked"), (3, 1, "wafers paper"), (3, 2, "bread paper"), (9, 1, " chilled "), (6, 1, "fresh"), (1, 4, "")]
    grouped = alternatives.group_values(spark.createDataFrame(values, "code int, row_id int, value string"), atoms)
    assert {(r.code, r.row_id): r.alt_group for r in grouped.collect()} == {(1, 1): "1:g0", (1, 2): "1:g0", (1, 3): "", (2, 1): "2:g0", (3, 1): "3:s0", (3, 2): "", (9, 1): "9:g0", (6, 1): "", (1, 4): ""}


def test_ingredients_and_the_percents_left_out(spark):
    texts = [(1, "flour 60% (wheat 99.5 %, salt{x 1%}), water, , oil 5% 6%"), (2, "a) b 2,5%, [c, d 3%"), (3, ""), (4, None), (5, "rice (origin Korea 100%) 30%，protein 9%、origin: Peru 100%")]
    df = spark.createDataFrame(texts, "text_id int, text string")
    got = [(r.text_id, r.name, r.percent) for r in alternatives.split_ingredients(df, "origin", "protein").orderBy("text_id", "segment").collect()]
    assert got == [
        (1, "flour", 60.0), (1, "water", None), (1, "oil", 5.0), (2, "a b 2", None), (2, "", 5.0), (2, "", None), (5, "rice", 30.0), (5, "protein", None), (5, "origin: Peru", None),
    ]
    left = sorted((r.text_id, r.percent, r.reason) for r in alternatives.excluded_percents(df, "origin", "protein").collect())
    assert left == [(1, 1.0, "nested"), (1, 6.0, "repeated"), (1, 99.5, "nested"), (2, 3.0, "nested"), (5, 9.0, "nutrition"), (5, 100.0, "nested"), (5, 100.0, "origin")]


def test_each_rule_of_evidence_decides_a_fact(spark):
    e = spark.createDataFrame(
        [("e1", 1, "label", True, "Rice flour 60 %, sea salt"), ("e2", 1, "label", False, "Keep cool, net 500 g"), ("e3", 1, "page", True, "fresh soy milk of Jeju"), ("e4", 2, "label", True, "Rice")],
        "ref string, product int, source string, in_section boolean, text string",
    )
    f = spark.createDataFrame(
        [
            (1, 1, "text", "rice  FLOUR", ["e1"]), (2, 1, "text", "rice", ["e1", "e9"]), (3, 1, "text", "rice", ["e4"]), (4, 1, "text", "rice", []), (5, 1, "text", "rice", None),
            (6, 1, "text", "rice 70 %", ["e1"]), (7, 1, "text", "rice 60%", ["e1", "e2"]), (8, 1, "ingredient", "soy milk", ["e3"]), (9, 1, "ingredient", "keep cool", ["e2"]), (10, 1, "ingredient", "sea salt", ["e1", "e3"]),
            (11, 1, "text", "salt rice", ["e1"]), (12, 1, "text", "salt rice cake tea", ["e1"]), (13, 1, "text", "salt cake tea", ["e1"]), (14, 1, "text", None, ["e1"]), (15, 1, "text", "salt jeju", ["e1", "e3"]),
        ],
        "fact_id int, product int, kind string, text string, refs array<string>",
    )
    got = {r.fact_id: r.verdict for r in evidence.validate_facts(f, e).collect()}
    assert got == {
        1: "valid", 2: "unknown_reference", 3: "unknown_reference", 4: "no_reference", 5: "no_reference", 6: "quantity_missing", 7: "valid", 8: "no_label_evidence", 9: "outside_section", 10: "valid",
        11: "valid", 12: "valid", 13: "not_supported", 14: "not_supported", 15: "valid",
    }


def test_fact_lines(spark):
    lines = [
        (1, 0, "Welcome"), (1, 1, "Ingredients:"), (1, 2, "rice"), (1, 3, "http://x"), (1, 4, "see package"), (1, 5, "salt"), (1, 6, "500 g left"), (1, 7, "more text"), (1, 8, "Net weight  300 g"), (1, 9, "Net contents"), (1, 10, "2 packs"),
        (2, 0, "500 g left"), (2, 1, "500 g left"), (2, 2, " "), (2, 3, None), (2, 4, "see package 3 g"),
    ]
    labels = spark.createDataFrame([("ingredients", 2), ("net", 0), ("net contents", 1)], "label string, most int")
    found = fact_lines.capture_fact_lines(spark.createDataFrame(lines, "page_id int, pos int, line string"), labels, "[a-z0-9]", "http", "[0-9]", "see package")
    got = sorted((r.page_id, r.pos, r.label or "", r.text) for r in found.collect())
    assert got == [(1, 1, "ingredients", "Ingredients: rice salt"), (1, 6, "", "500 g left"), (1, 8, "net", "Net weight 300 g"), (1, 9, "net contents", "Net contents 2 packs"), (2, 0, "", "500 g left")]


def test_summary_fields(spark):
    lines = [(1, 0, "Weight"), (1, 1, "Origin"), (1, 2, "Korea"), (1, 3, "9,900원"), (1, 4, "Weight"), (1, 5, "about"), (1, 6, "500 g"), (1, 7, "more"), (1, 8, "Care"), (1, 9, "상품설명 x"), (2, 0, "Care"), (2, 1, "keep"), (3, 0, "Care")]
    labels = spark.createDataFrame([("Weight",), ("Origin",), ("Care",)], "label string")
    found = fact_lines.summary_fields(spark.createDataFrame(lines, "page_id int, pos int, line string"), labels, "^상품설명", "(원|%)$")
    assert sorted((r.page_id, r.field, r.value) for r in found.collect()) == [(1, "Origin", "Korea"), (1, "Weight", "about 500 g"), (2, "Care", "keep")]


def test_cells_and_regions_are_not_broadcast(spark):
    """Repeated texts shrink when written, so their size on disk must not decide; what grows is sorted and merged."""
    cells = spark.range(400).selectExpr("id % 40 AS page", "1 AS table_no", "cast(id / 40 AS int) AS row_no", "1 AS cell_no", "'red cod 5 g' AS text")
    regions = spark.range(80).selectExpr("id % 40 AS page", "cast(id / 40 AS int) AS region", "'red cod 5 g' AS text")
    found = grounding.ground_cells(cells, regions)
    assert found.where("grounded").count() == 400
    found.collect()
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_few_and_many_labels_capture_the_same(spark, monkeypatch):
    lines = spark.createDataFrame([(1, 0, "Net weight"), (1, 1, "500 g"), (1, 2, "or so"), (2, 0, "7 kg"), (2, 1, "Weight"), (2, 2, "ag")], "page_id int, pos int, line string")
    labels = spark.createDataFrame([("weight", 1), ("net weight", 2), ("", 3)], "label string, most int")
    run = lambda: sorted((tuple(r) for r in fact_lines.capture_fact_lines(lines, labels, "[a-z0-9]", "http", "[0-9]", "###").collect()), key=repr)
    few = run()
    assert (1, 0, "net weight", "Net weight 500 g or so") in few and (2, 0, None, "7 kg") in few and (2, 1, "weight", "Weight ag") in few
    plan = fact_lines.capture_fact_lines(lines, labels, "[a-z0-9]", "http", "[0-9]", "###")._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan
    monkeypatch.setattr(fact_lines, "FEW", 0)
    assert run() == few


def test_facts_meet_their_evidence_in_one_join(spark):
    e = spark.createDataFrame([("a", 1, "label", True, "rice 60 g salt"), ("b", 1, "page", False, "tea 60 g 5 kg cake")], "ref string, product int, source string, in_section boolean, text string")
    f = spark.createDataFrame([(1, 1, "text", "rice tea cake 5 kg 60 g", ["a", "b", "a", None]), (2, 1, "text", "tea 7 kg", ["a", "b"])], "fact_id int, product int, kind string, text string, refs array<string>")
    found = evidence.validate_facts(f, e)
    assert {tuple(r) for r in found.collect()} == {(1, "valid"), (2, "quantity_missing")}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
