"""Contexts of headings: fixed rows for each rule of a clause and of their union."""

from dutyweave.operators import context


def verdicts(spark, cases):
    """(verdict, reason, conditions) of each case (label, bound, texts, wrapper, taxon), all in one run."""
    n = list(enumerate(cases))
    df = spark.createDataFrame
    asks = df([(i, f"c{i}") for i, _ in n], "product int, code string")
    labels = df([(f"c{i}", c[0]) for i, c in n], "code string, label string")
    b = df([(i, a, "answered", t) for i, c in n for a, t in c[1]], "product int, axis string, status string, tokens string")
    t = df([(i, a, v) for i, c in n for a, v in c[2]], "product int, axis string, value string")
    w = df([(i, c[3]) for i, c in n if c[3] is not None], "product int, wrapper boolean")
    x = df([(i, f"c{i}", c[4]) for i, c in n if c[4]], "product int, code string, verdict string")
    got = context.context_verdicts(asks, labels, context.product_signs(b, t, w), x).orderBy("product").collect()
    return [(r.verdict, r.reason, [(c.axis, c.expected, c.value, c.verdict, c.reason) for c in r.conditions]) for r in got]


def case(label, bound=(), texts=(), wrapper=None, taxon=None):
    return label, bound, texts, wrapper, taxon


CLAUSES = [
    ("Uncooked pasta, not stuffed", [("processing_method", "yes", ["uncooked"]), ("physical_form", "not", ["stuffed"]), ("product_identity", "yes", ["pasta"])]),
    ("Fish, frozen, fresh or chilled", [("preservation_state", "yes", ["chilled", "fresh", "frozen"]), ("product_identity", "yes", ["fish"])]),
    ("Whole or minced", [("physical_form", "one_of", ["minced", "whole"])]),
    ("Whole, minced", [("physical_form", "yes", ["minced"]), ("physical_form", "yes", ["whole"])]),
    ("Pasta, not stuffed or otherwise prepared", [("physical_form", "not", ["stuffed"]), ("otherwise_prepared", "not", ["otherwise prepared"]), ("product_identity", "yes", ["pasta"])]),
    ("Pasta otherwise prepared", [("otherwise_prepared", "yes", ["otherwise prepared"]), ("product_identity", "yes", ["pasta"])]),
    ("whether or not stuffed", [("branch_context", "open", [])]),
    ("Other, not elsewhere specified", [("branch_context", "no_gate", [])]),
    ("Otherwise prepared or preserved", [("branch_context", "no_gate", [])]),
    (" 12 ", [("branch_context", "empty", [])]),
    (None, [("branch_context", "empty", [])]),
]


def test_clauses(spark):
    labels = spark.createDataFrame([(i, label) for i, (label, _) in enumerate(CLAUSES)], "code int, label string")
    got = {r.code: [(c.axis, c.expected, c.words) for c in r.clauses] for r in context.context_clauses(labels).collect()}
    assert got == {i: want for i, (_, want) in enumerate(CLAUSES)}


def test_rows_that_one_rule_decides(spark):
    form, proc, keep, name = "physical_form", "processing_method", "preservation_state", "product_identity"
    want = [
        (case("stuffed", [(form, "filled parcel")]), ("O", "O", "canonical_form_match")),
        (case("not stuffed", [(form, "filled parcel")]), ("X", "X", "canonical_form_match")),
        (case("minced", [(form, "fillet")]), ("X", "X", "canonical_form_opposite")),
        (case("not minced", [(form, "fillet")]), ("O", "O", "canonical_form_opposite")),
        (case("whole", [(form, "whole puree")]), ("SILENCE", "SILENCE", "physical_form_conflict")),
        (case("whole"), ("SILENCE", "SILENCE", "physical_form_unanswered")),
        (case("stuffed", texts=[(form, "non-stuffed")]), ("X", "X", "explicit_negation")),
        (case("not stuffed", texts=[(form, "not stuffed")], wrapper=False), ("O", "O", "explicit_negation")),
        (case("not stuffed", texts=[(form, "not stuffed")], wrapper=True), ("SILENCE", "SILENCE", "polarity_conflict:wrapper_true")),
        (case("stuffed", texts=[(form, "filled wheat dough")], wrapper=False), ("SILENCE", "SILENCE", "polarity_conflict:wrapper_false")),
        (case("stuffed", texts=[(form, "filled wheat dough")], wrapper=True), ("O", "O", "affirmative_source_text")),
        (case("stuffed", texts=[(form, "filled"), (form, "not filled")]), ("SILENCE", "SILENCE", "polarity_conflict")),
        (case("stuffed", texts=[(form, "whether or not cooked or stuffed")]), ("SILENCE", "SILENCE", "neutral_scope_qualifier")),
        (case("stuffed", wrapper=True), ("SILENCE", "SILENCE", "wrapper_requires_text_corroboration")),
        (case("uncooked", [(proc, "require cooking")]), ("O", "O", "processing_state_equivalent")),
        (case("cooked", [(proc, "requires_cooking")]), ("X", "X", "processing_state_opposite")),
        (case("cooked", [(proc, "cooked uncooked")]), ("SILENCE", "SILENCE", "processing_state_conflict")),
        (case("cooked", [(proc, "roasted")]), ("SILENCE", "SILENCE", "processing_state_unresolved")),
        (case("frozen or dried", [(keep, "dried")]), ("O", "O", "preservation_state_match")),
        (case("frozen", [(keep, "dried")]), ("X", "X", "preservation_state_mismatch")),
        (case("frozen", [(keep, "dried"), (keep, "frozen"), (keep, "frozen")]), ("O", "O", "preservation_state_match")),
        (case("frozen"), ("SILENCE", "SILENCE", "preservation_state_empty")),
        (case("wheat pasta", [(name, "dry pasta wheat")]), ("O", "O", "canonical_identity_match")),
        (case("wheat pasta", [(name, "pasta")]), ("SILENCE", "SILENCE", "identity_not_proven")),
        (case("wheat pasta", [(name, "pasta")], taxon="X"), ("X", "X", "taxonomy")),
        (case("wheat pasta", taxon="SILENCE"), ("SILENCE", "SILENCE", "canonical_field_empty")),
    ]
    got = verdicts(spark, [c for c, _ in want])
    assert [(v, c[0][3], c[0][4]) for v, _, c in got] == [w for _, w in want]


def test_otherwise_prepared_comes_from_texts(spark):
    yes, no = "fish, otherwise prepared", "fish, not otherwise prepared"
    want = [
        (yes, ["Pre-cooked"], ("O", "explicit_otherwise_prepared")),
        (no, ["otherwise_prepared"], ("X", "explicit_otherwise_prepared")),
        (no, ["not cut or otherwise prepared"], ("O", "explicit_not_otherwise_prepared")),
        (yes, ["plain uncooked"], ("X", "explicit_not_otherwise_prepared")),
        (yes, ["unprepared", "precooked"], ("SILENCE", "otherwise_prepared_conflict")),
        (yes, ["raw"], ("SILENCE", "otherwise_prepared_unanswered")),
    ]
    got = verdicts(spark, [case(label, texts=[("otherwise_prepared", t) for t in texts]) for label, texts, _ in want])
    assert [[x[3:] for x in c if x[0] == "otherwise_prepared"] for _, _, c in got] == [[w] for _, _, w in want]


def test_all_clauses_must_be_answered(spark):
    full = [("processing_method", "uncooked"), ("product_identity", "pasta")]
    label = "Uncooked pasta, not stuffed"
    want = [
        (case(label, full, [("physical_form", "not stuffed")]), ("O", "all_context_conditions_confirmed")),
        (case(label, full), ("SILENCE", "context_condition_unanswered")),
        (case(label, [("processing_method", "cooked")]), ("X", "context_condition_violated")),
        (case("Stuffed or minced", [("physical_form", "minced")]), ("SILENCE", "context_clause_coverage_incomplete")),
        (case("Whole or pieces", [("physical_form", "paste")]), ("X", "context_condition_violated")),
        (case("Other"), ("O", "residual_context_no_gate")),
        (case(""), ("SILENCE", "empty_context")),
        (case("whether or not stuffed"), ("SILENCE", "context_clause_coverage_incomplete")),
    ]
    assert [g[:2] for g in verdicts(spark, [c for c, _ in want])] == [w for _, w in want]


def test_no_products_and_no_labels(spark):
    asks = spark.createDataFrame([(1, "c"), (1, "c"), (None, "d")], "product int, code string")
    none = [spark.createDataFrame([], s) for s in ("code string, label string", "product int, axis string, status string, tokens string", "product int, axis string, value string", "product int, wrapper boolean", "product int, code string, verdict string")]
    got = context.context_verdicts(asks, none[0], context.product_signs(*none[1:4]), none[4]).collect()
    assert sorted((r.code, r.verdict, r.reason) for r in got) == [("c", "SILENCE", "empty_context"), ("d", "SILENCE", "empty_context")]
    assert context.context_verdicts(asks.limit(0), none[0], context.product_signs(*none[1:4]), none[4]).count() == 0


def test_each_label_is_read_once(spark, monkeypatch):
    kept, write = {}, context.stage
    monkeypatch.setattr(context, "stage", lambda rows, label: kept.setdefault(label, write(rows, label)))
    labels = spark.createDataFrame([(i, ["Other", None, "", "Fish, frozen"][i % 4]) for i in range(40)], "code int, label string")
    got = {r.code: [c.expected if c.axis == "branch_context" else c.axis for c in r.clauses] for r in context.context_clauses(labels).collect()}
    assert got == {i: [["no_gate"], ["empty"], ["empty"], ["preservation_state", "product_identity"]][i % 4] for i in range(40)}
    assert kept["clauses"].count() == 3
