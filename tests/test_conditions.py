"""Conditions compiled from labels: one fixed row for each rule."""

from pyspark.sql import functions as F

from dutyweave.operators import conditions as ops
from dutyweave.operators.conditions import Pattern

PATTERNS = [
    Pattern("preservation_state", "state", r"\b(?:frozen|fresh|dried|salted)\b"),
    Pattern("processing_method", "state", r"\b(?:cooked|steaming|used)\b"),
    Pattern("species_source", "noun", r"\b(?:swine|bovine|dried)\b"),
    Pattern("material_composition", "operator", r"\b(containing|of)\b"),
    Pattern("quantitative_threshold", "quantity", r"\b(?:weighing|exceeding)\b"),
]
STATES = ["frozen", "fresh"]


def parts(spark, *labels):
    """Each label in a family of its own, so that no word is common."""
    df = spark.createDataFrame([(i, str(i), x) for i, x in enumerate(labels)], "family int, code string, label string")
    return df, ops.label_parts(df)


def test_typed_conditions(spark):
    want = {
        "Fish ; Frozen fillets": [("preservation_state", ["frozen"])],
        "Frozen ; Fillets": [("preservation_state", ["frozen"])],
        "Swine ; Fillets": [],
        "Meat ; Swine, frozen": [("preservation_state", ["frozen"]), ("species_source", ["swine"])],
        "Other": [],
        "Goods ; Other, frozen": [],
        "Pasta, whether or not frozen": [],
        "Pasta, not frozen": [],
        "Bags of paper, 2 kg. Of wool": [("material_composition", ["paper"])],
        "Bags of paper; wool": [("material_composition", ["paper"])],
        "Bags of paper frozen wool": [("material_composition", ["paper"]), ("preservation_state", ["frozen"])],
        "Paper ; Bags of paper and wool": [("material_composition", ["paper", "wool"])],
        "Paper, wool ; Bags of wool": [("material_composition", ["wool"])],
        "Paper ; Bags containing stop and " + "leather or " * 6 + "velvets": [("material_composition", ["leather"])],
        "Bags exceeding 2 kg": [("quantitative_threshold", None)],
        "Bags, not more than 2 kg": [("quantitative_threshold", None)],
        "Bags, not stuffed": [],
        "Dried": [("preservation_state", ["dried"]), ("preservation_state", ["dried"])],
        None: [],
        "": [],
    }
    _, p = parts(spark, *want)
    got = {}
    for r in ops.typed_conditions(p, PATTERNS, ["stop"], STATES).collect():
        got.setdefault(r.family, []).append((r.axis, r.words))
    assert {label: sorted(got.get(i, []), key=str) for i, label in enumerate(want)} == {k: sorted(v, key=str) for k, v in want.items()}


def test_words_of_more_than_half_of_the_siblings_tell_nothing(spark):
    df = spark.createDataFrame([(1, str(i), x) for i, x in enumerate(["Salted fresh ham", "Salted ham", "Salted dried ham", "Fresh bacon"])], "family int, code string, label string")
    got = {r.code: r.words for r in ops.typed_conditions(ops.label_parts(df), PATTERNS[:1], [], []).collect()}
    assert got == {"3": ["fresh"]}  # the first match decides, and "salted" is held by two of the three siblings
    common = {r.code: sorted(r.common) for r in ops.label_parts(df).collect()}
    assert common["0"] == ["ham", "salted"]


def test_words_above_that_a_sibling_names_still_tell(spark):
    df = spark.createDataFrame([(1, "1", "Herring, cobia ; Cobia"), (1, "2", "Herring, cobia ; Tuna")], "family int, code string, label string")
    assert {r.code: r.above for r in ops.label_parts(df).collect()} == {"1": ["herring"], "2": ["herring"]}


def test_qualifiers(spark):
    _, p = parts(spark, "Machines of iron, not used ; Fresh, dried or FRESH", "Other ; Salted", "Plain", "Steel ; Other, fresh", None)
    sets = {"state_set": ("preservation_state", ["preservation_state"], ["dried", "fresh"])}
    got = {(r.family, r.kind): r.words for r in ops.qualifiers(p, PATTERNS, sets, ["iron"]).collect()}
    assert got == {(0, "ancestor"): ["machine"], (0, "state_set"): ["dried", "fresh"], (3, "ancestor"): ["steel"]}


def test_fallback_identity(spark):
    df, p = parts(spark, "Bread (wafers or rice paper), frozen", "Meat ; Swine", "Goods ; Used", "Used", "Used goods here", "Other", "Baked ; Cake, cooked biscuits", "")
    stop = ["used", "good", "here"]
    typed = ops.typed_conditions(p, PATTERNS, stop, STATES)
    rows = ops.fallback_identity(p, typed, df, PATTERNS, stop, STATES).collect()
    got = sorted((r.family, r.axis, r.words, r.alt_group, r.grade) for r in rows)
    assert got == [
        (0, "product_identity", ["bread"], "", "fallback"),
        (0, "product_identity", ["wafer", "rice paper"], "g0", "fallback"),
        (2, "processing_method", ["used"], "", "named"),
        (3, "processing_method", ["used"], "", "named"),
        (6, "product_identity", ["cake", "biscuit"], "", "fallback"),
    ]


def test_note_conditions(spark):
    _, p = parts(spark, "Molluscs ; Mussels", "Other")
    excl = "The heading does not cover "
    notes = [
        ("0", "note_excl", 1, excl + "mussels prepared, snails; cooked snails or raw squid"),  # ";" does not end the clause, but two phrases of a clause are the most
        ("0", "note_excl", 2, excl + "sea cucumbers. It excludes: dried jellyfish and not exceeding"),
        ("0", "note_excl", 3, None),
        ("0", "rule_excl", 1, "Excluding fish oils, sea cucumbers"),
        ("0", "note_incl", 1, "oysters, the clams"),
        ("0", "note_incl", 2, "clams or cockles and scallops"),
        ("0", "note_incl", 3, "whelks"),
        ("1", "note_incl", 1, "oysters"),
        ("1", "note_excl", 1, "nothing is said"),
        ("9", "note_excl", 1, excl + "raw squid"),
    ]
    df = spark.createDataFrame(notes, "code string, kind string, pos int, text string")
    got = sorted((r.code, r.kind, r.place, r.phrase) for r in ops.note_conditions(df, p, ["the"]).collect())
    assert got == [
        ("0", "exclusion", 0, "sea cucumber"),
        ("0", "exclusion", 1, "dried jellyfish"),
        ("0", "exclusion", 2, "fish oil"),
        ("0", "inclusion", 0, "oyster"),
        ("0", "inclusion", 1, "clam"),
        ("0", "inclusion", 2, "cockle"),
    ]
    assert ops.note_conditions(df.where(F.lit(False)), p, []).count() == 0


def test_empty_table(spark):
    df, p = parts(spark, "x")
    none = p.where("false")
    typed = ops.typed_conditions(none, PATTERNS, [], [])
    assert typed.count() == 0 and ops.qualifiers(none, PATTERNS, {}, []).count() == 0
    assert ops.fallback_identity(none, typed, df.where("false"), PATTERNS, [], []).count() == 0


def test_a_phrase_of_an_unread_note_may_come_with_the_next_kind(spark, tmp_path):
    import duckdb

    from dutyweave.plans import condition_queries

    # two notes fill the four; "widget glass" stands in a third, unread one, then in the first note of the next kind
    lines = [(3, 3, 1000, 100), (3, 3, 2000, 104), (3, 3, 3000, 101), (3, 1, 4000, 105)]
    spark.createDataFrame(lines, "l_partkey long, l_linenumber int, l_orderkey long, l_suppkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    spark.createDataFrame([(3, "red widget", "SMALL", 7)], "p_partkey long, p_name string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found, sql = condition_queries.QUERIES["note_conditions"]
    got = sorted((r.code, r.kind, r.phrase, r.place) for r in found(spark, str(tmp_path)).collect())
    c = duckdb.connect()
    for t in ("part", "lineitem"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet/*.parquet')")
    want = sorted(c.execute(f"SELECT code, kind, phrase, place FROM ({sql})").fetchall())
    assert got == want and "widget glass" in [r[2] for r in got]
