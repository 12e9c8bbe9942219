"""Registered queries on facts, axes, polarity and concepts, with their SQL twins."""

from __future__ import annotations

from dutyweave.operators import binding as ops
from dutyweave.plans import views
from dutyweave.plans.requirement_queries import values
from dutyweave.plans.text_queries import D_STEM
from pyspark.sql import functions as F

TIERS = [("identity", 0, "identity_hints", "identity"), ("species", 0, "composition_facts", "composition"), ("species", 1, "identity_hints", "identity"), ("form", 0, "identity_hints", "form"), ("form", 0, "identity_hints", "wrapper")]
REGISTERS = [("wrapper", "stuffed"), ("wrapper", "filled")]
FACTS = """SELECT p_partkey AS product, 'identity' AS path, p_name AS value FROM {part}
UNION ALL SELECT p_partkey, 'composition', CASE WHEN p_partkey % 3 = 0 THEN ' Unknown' ELSE p_type END FROM {part}
UNION ALL SELECT p_partkey, 'form', p_brand FROM {part} WHERE p_partkey % 5 <> 1"""
QUESTIONS = """SELECT p_partkey AS product, 'identity' AS axis, '' AS words FROM {part} UNION ALL SELECT p_partkey, 'species', 'shrimp' FROM {part}
UNION ALL SELECT p_partkey, 'form', CASE WHEN p_partkey % 2 = 0 THEN 'stuffed,thick' ELSE 'minced' END FROM {part} UNION ALL SELECT p_partkey, 'technical', 'power' FROM {part}"""
#: Wordings and what each says of "stuffed" and "filled".
WORDINGS = [
    ("stuffed pasta", "positive"), ("filled pasta", "positive"), ("not stuffed", "negated"), ("non-stuffed", "negated"), ("unfilled shells", "negated"),
    ("whether or not cooked or stuffed", "neutral"), ("stuffed pasta; not at all stuffed", "conflict"), ("pasta", "absent"), ("no longer very much stuffed", "positive"), ("", "absent"),
]
VERDICTS = {"positive": ("true", 3, "affirmative_source_text"), "negated": ("false", -100, "explicit_negation"), "neutral": ("unknown", 0, "neutral_scope_qualifier"), "conflict": ("unknown", 0, "polarity_conflict")}
EDGES = [("aquatic_invertebrate", None), ("mollusc", "aquatic_invertebrate"), ("cephalopod", "mollusc"), ("octopus", "cephalopod"), ("crustacean", "aquatic_invertebrate"), ("shrimp", "crustacean"), ("fish", None), ("cod", "fish"), ("pollack", "fish")]
LABELS = [(c, c.replace("_", " ")) for c, _ in EDGES] + [("mollusc", "molluscs"), ("crustacean", "crustaceans"), ("shrimp", "white-leg shrimp")]
ASKED = [("crustaceans", "white-leg shrimp", "O", "fact_is_question_or_descendant"), ("shrimp", "a crustacean", "SILENCE", "fact_is_only_question_ancestor"), ("shrimp", "cod", "X", "authoritative_taxa_disjoint"), ("cod", "pollack", "X", "authoritative_taxa_disjoint"),
         ("langoustine", "unknown seafood", "SILENCE", "taxonomy_term_unresolved"), ("cod", "decode product", "SILENCE", "taxonomy_term_unresolved"), ("sea bream", " Sea  bream", "O", "exact_phrase"), ("mollusc", "octopus and fish", "O", "fact_is_question_or_descendant")]
STATES, FORMS = ["economy", "hot", "promo", "small", "standard"], ["bag", "box", "can", "drum", "jar"]
AXES = """SELECT p_partkey AS row_id, CASE p_size % 4 WHEN 0 THEN 'preservation_state' WHEN 1 THEN 'physical_form' WHEN 2 THEN 'product_identity' ELSE 'species_source' END AS axis,
  CASE p_partkey % 9 WHEN 0 THEN 'Other, ' || p_type WHEN 1 THEN 'Not elsewhere specified or included, ' || p_type WHEN 2 THEN p_name || ' n.e.s.' WHEN 3 THEN '' WHEN 4 THEN p_name ELSE p_type || CASE p_size % 3 WHEN 0 THEN ' box of ' WHEN 1 THEN ' large jars with ' ELSE ' ' END || p_name END AS label,
  CASE WHEN p_size % 7 = 0 THEN 'empty' ELSE 'answered' END AS status,
  CASE p_partkey % 3 WHEN 0 THEN 'economy' WHEN 1 THEN 'box' ELSE lower(p_type) END || ',' || split_part(p_name, ' ', 1 + p_size % 2) AS tokens,
  CASE WHEN p_partkey % 11 = 0 THEN lower(p_type) ELSE '' END AS denied, CASE WHEN p_partkey % 4 = 0 THEN split_part(p_name, ' ', 1) ELSE '' END AS first, split_part(p_name, ' ', 1) AS accessory FROM {part}"""


def for_duckdb(text):
    return text.replace("{part}", "part").replace("{lineitem}", "lineitem").replace("<S>", "VARCHAR")


def rows(s, d, text, name="part"):
    return s.sql(text.replace("<S>", "STRING"), **{name: views.table(s, d, name)})


def closure_values():
    """Concepts with all ancestors, from EDGES."""
    up = dict(EDGES)
    found = []
    for c in up:
        a, k = c, 0
        while a is not None:
            found.append((c, a, k))
            a, k = up[a], k + 1
    return found


def pick(items, of):
    """The item of a list that a row's number selects."""
    return F.element_at(F.array(*[F.lit(x) for x in items]), (of % len(items) + 1).cast("int"))


def case(items, of):
    return f"CASE {of} % {len(items)} " + " ".join(f"WHEN {i} THEN " + (str(x) if isinstance(x, int) else "'" + x.replace("'", "''") + "'") for i, x in enumerate(items)) + " END"


def words(text):
    return F.filter(F.split(text, ","), lambda w: w != "")


def _bound(s, d):
    part = views.table(s, d, "part")
    flags = part.where("p_partkey % 4 < 2").select(F.col("p_partkey").alias("product"), F.lit("wrapper").alias("path"), (F.col("p_size") % 2 == 0).alias("flag"))
    asked = rows(s, d, QUESTIONS).withColumn("words", words(F.col("words")))
    return ops.bind_axis(asked, rows(s, d, FACTS), flags, s.createDataFrame(TIERS, "axis string, tier int, lane string, path string"), s.createDataFrame(REGISTERS, "path string, word string"))


ENTRIES = """SELECT l_suppkey AS product, CASE WHEN l_linenumber % 2 = 0 THEN 'facts.contains_sauce_or_broth' ELSE 'facts.names' END AS path, l_linenumber + l_partkey % 5 AS order_index,
  CASE WHEN l_partkey % 7 = 0 THEN 'N/A' ELSE 'Item' || CAST(l_partkey % 50 AS <S>) || ' boxes of it' END AS value, CASE WHEN l_linenumber % 2 = 0 THEN l_suppkey % 3 = 0 END AS flag FROM {lineitem}"""
LEVEL_VALUES = """SELECT l_suppkey AS product, CASE WHEN l_linenumber % 2 = 0 THEN 'a' ELSE 'b' END AS axis, CASE l_linenumber % 3 WHEN 0 THEN 'hints' WHEN 1 THEN 'names' ELSE 'forms' END AS path, l_orderkey * 10 + l_linenumber AS pos FROM {lineitem}"""
CONDITIONS = """SELECT p_partkey AS code, CASE (p_partkey + p_size) % 5 WHEN 0 THEN 'product_identity' WHEN 1 THEN 'species_source' WHEN 2 THEN 'physical_form' WHEN 3 THEN 'identity_fallback' ELSE 'preservation_state' END AS axis,
  CASE WHEN p_size % 6 = 0 THEN 'qualifier' ELSE 'discriminator' END AS role, p_name AS value FROM {part}"""
PRIMARY = ["product_identity", "physical_form", "preservation_state", "species_source"]
CHILDREN = """SELECT l_suppkey AS product, l_partkey % 40 AS parent, CAST(l_partkey % 40 % 7 AS DOUBLE) AS parent_score, l_orderkey * 10 + l_linenumber AS code, l_quantity AS score FROM {lineitem}"""
CHOICES = """SELECT l_orderkey AS product, l_linenumber AS pos, lpad(CAST(l_partkey % 24 + 1 AS <S>), 2, '0') AS chapter, 'p' || CAST(l_suppkey % 3 AS <S>) AS path, CASE WHEN l_suppkey % 4 = 0 THEN 'made_up' ELSE 'chapter_title' END AS field FROM {lineitem}"""
FACT_ROWS = """SELECT l_orderkey AS product, 'n' || CAST(l_linenumber AS <S>) AS name, CASE WHEN l_linenumber % 2 = 0 THEN CAST(l_partkey % 9 AS <S>) || ' G' ELSE CAST(l_partkey % 9 AS <S>) || 'g' END AS value, l_linenumber AS pos, l_linenumber <= 2 AS is_fact, l_suppkey % 2 = 0 AS accepted FROM {lineitem}"""
TOKENS_OF = "SELECT string_agg(DISTINCT x, ' ' ORDER BY x) FROM (SELECT {stem} AS x FROM (SELECT unnest(regexp_extract_all(lower({text}), '[a-z0-9]+')) AS w) WHERE length(w) >= 3)"


def _tokens_of(text):
    return "(" + TOKENS_OF.replace("{stem}", D_STEM).replace("{text}", text) + ")"


QUERIES = {
    "bind_axis": (
        _bound,
        f"""WITH t AS (SELECT p_partkey AS k, p_size % 2 = 0 AS flag, p_partkey % 4 < 2 AS flagged, {_tokens_of('p_name')} AS nt, {_tokens_of('p_type')} AS ct, {_tokens_of('p_brand')} AS ft FROM part)
        SELECT k AS product, 'identity' AS axis, 'answered' AS status, 0 AS tier, 'identity_hints' AS lane, nt AS tokens, '' AS affirmed, '' AS denied FROM t
        UNION ALL SELECT k, 'species', 'answered', CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END, CASE WHEN k % 3 = 0 THEN 'identity_hints' ELSE 'composition_facts' END, CASE WHEN k % 3 = 0 THEN nt ELSE ct END, '', '' FROM t
        UNION ALL SELECT k, 'technical', 'unsupported', -1, '', '', '', '' FROM t
        UNION ALL SELECT k, 'form', CASE WHEN (k % 2 = 0 AND flagged) OR k % 5 <> 1 THEN 'answered' ELSE 'empty' END, 0, CASE WHEN k % 2 = 0 AND flagged THEN 'composition_facts' ELSE 'identity_hints' END,
          CASE WHEN k % 2 = 0 AND flagged THEN CASE WHEN flag THEN 'filled stuffed' ELSE '' END WHEN k % 5 <> 1 THEN ft ELSE '' END,
          CASE WHEN k % 2 = 0 AND flagged AND flag THEN 'filled stuffed' ELSE '' END, CASE WHEN k % 2 = 0 AND flagged AND NOT flag THEN 'filled stuffed' ELSE '' END FROM t""",
    ),
    "field_tokens": (
        lambda s, d: ops.field_tokens(rows(s, d, ENTRIES, "lineitem")),
        f"""WITH e AS ({for_duckdb(ENTRIES)}), w AS (SELECT product, path, unnest(regexp_extract_all(lower(value), '[a-z0-9]+')) AS w FROM e WHERE flag IS NULL AND value <> 'N/A' AND order_index <= 8)
        SELECT DISTINCT product, path, {D_STEM} AS token FROM w WHERE length(w) >= 3 UNION ALL SELECT DISTINCT product, path, unnest(['sauce', 'broth']) FROM e WHERE flag""",
    ),
    "project_facts": (
        lambda s, d: ops.project_facts(rows(s, d, ENTRIES, "lineitem").withColumnRenamed("order_index", "pos"), ["facts.names", "facts.contains_sauce_or_broth"]).groupBy("product", "path").agg(F.count(F.lit(1)).alias("n"), F.max("value").alias("last")),
        f"""WITH e AS (SELECT *, row_number() OVER (PARTITION BY product, path ORDER BY order_index, value) AS pos FROM ({for_duckdb(ENTRIES)})),
        u AS (SELECT *, row_number() OVER (PARTITION BY product, path ORDER BY pos) AS k FROM e WHERE coalesce(flag, value <> 'N/A')) SELECT product, path, count(*) AS n, max(value) AS last FROM u WHERE k <= 10 GROUP BY ALL""",
    ),
    "facts_for_level": (
        lambda s, d: ops.facts_for_level(rows(s, d, LEVEL_VALUES, "lineitem"), 6, "hints"),
        f"WITH v AS ({for_duckdb(LEVEL_VALUES)}) SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY product, axis ORDER BY path, pos) AS place FROM v WHERE path <> 'hints') WHERE place <= 16",
    ),
    "project_conditions": (
        lambda s, d: ops.project_conditions(rows(s, d, CONDITIONS), views.table(s, d, "part").select(F.col("p_partkey").alias("code"), pick(PRIMARY, F.col("p_partkey")).alias("primary_axis"))),
        f"""WITH c AS ({for_duckdb(CONDITIONS)}), j AS (SELECT *, {case(PRIMARY, 'code')} AS primary_axis FROM c WHERE role <> 'qualifier'),
        k AS (SELECT *, axis IN ('product_identity', 'species_source', 'identity_fallback') AND primary_axis IN ('product_identity', 'species_source') AS fam FROM j)
        SELECT code, axis, role, value, primary_axis, CASE WHEN fam THEN CAST(code AS VARCHAR) || ':primary_axis' END AS or_group FROM k WHERE fam OR axis = primary_axis""",
    ),
    "polarity_verdicts": (
        lambda s, d: ops.polarity_verdicts(views.table(s, d, "part").select(F.col("p_partkey").alias("case_id"), F.concat_ws(" ", pick([w for w, _ in WORDINGS], F.col("p_partkey")), F.regexp_replace(F.lower("p_type"), "[^a-z]", "")).alias("text"), F.when(F.col("p_size") % 3 == 0, F.lit(False)).when(F.col("p_size") % 3 == 1, F.lit(True)).alias("wrapper")), ["stuffed", "filled"]),
        f"""WITH k AS (SELECT p_partkey AS case_id, {case([k for _, k in WORDINGS], 'p_partkey')} AS kind, p_size % 3 < 2 AS known FROM part)
        SELECT case_id, CASE kind WHEN 'positive' THEN 'true' WHEN 'negated' THEN 'false' ELSE 'unknown' END AS verdict, CASE kind WHEN 'positive' THEN 3 WHEN 'negated' THEN -100 ELSE 0 END AS score,
        CASE kind {" ".join(f"WHEN '{k}' THEN '{v[2]}'" for k, v in VERDICTS.items())} ELSE CASE WHEN known THEN 'wrapper_requires_text_corroboration' ELSE 'no_source_text' END END AS reason FROM k""",
    ),
    "axis_verdicts": (
        lambda s, d: ops.axis_verdicts(rows(s, d, AXES).withColumns({c: words(F.col(c)) for c in ("tokens", "denied", "first", "accessory")}), STATES, FORMS),
        f"""WITH a AS ({for_duckdb(AXES)}), o AS (SELECT *, list_distinct(list_filter(list_transform(regexp_extract_all(lower(label), '[a-z0-9]+'), lambda w: {D_STEM}), lambda x: length(x) >= 3)) AS own, string_split(tokens, ',') AS tk FROM a),
        m AS (SELECT *, list_intersect(own, {STATES}) AS st, CASE axis WHEN 'physical_form' THEN list_intersect(own, {FORMS}) ELSE own END AS asked FROM o), n AS (SELECT *, list_intersect(asked, tk) AS hit FROM m)
        SELECT row_id, CASE WHEN label = '' THEN 'none' WHEN regexp_matches(lower(label), '^(other\\b|not elsewhere|n\\.e\\.s)') THEN 'resid' WHEN denied <> '' AND list_contains(own, denied) THEN 'X' WHEN status <> 'answered' THEN 'none'
          WHEN axis = 'preservation_state' THEN CASE WHEN len(st) = 0 THEN 'none' WHEN list_has_any(st, tk) THEN 'O' ELSE 'X' END WHEN axis = 'physical_form' AND len(asked) = 0 THEN 'none' WHEN len(hit) = 0 THEN 'X'
          WHEN axis = 'species_source' AND list_contains(hit, accessory) AND first <> accessory AND len(list_filter(hit, lambda x: x <> accessory)) = 0 THEN 'X' ELSE 'O' END AS verdict FROM n""",
    ),
    "answer_concepts": (
        lambda s, d: ops.answer_concepts(views.table(s, d, "part").select(F.col("p_partkey").alias("pair_id"), pick([a[0] for a in ASKED], F.col("p_partkey")).alias("question"), pick([a[1] for a in ASKED], F.col("p_partkey")).alias("fact")), s.createDataFrame(LABELS, "concept string, label string"), s.createDataFrame(closure_values(), "concept string, ancestor string, distance int")),
        f"SELECT p_partkey AS pair_id, {case([a[2] for a in ASKED], 'p_partkey')} AS verdict, {case([a[3] for a in ASKED], 'p_partkey')} AS reason FROM part",
    ),
    "merge_families": (
        lambda s, d: ops.merge_families(rows(s, d, CHILDREN, "lineitem")),
        f"""WITH c AS ({for_duckdb(CHILDREN)}), f AS (SELECT *, row_number() OVER (PARTITION BY product, parent ORDER BY score DESC, code) AS in_family FROM c)
        SELECT *, row_number() OVER (PARTITION BY product ORDER BY parent_score DESC, in_family, score DESC, code) AS place FROM f""",
    ),
    "validate_choices": (
        lambda s, d: ops.validate_choices(rows(s, d, CHOICES, "lineitem"), views.goods(s, d).select(F.left("code10", F.lit(2)).alias("chapter")).where("chapter <> '07'").distinct(), rows(s, d, CHOICES, "lineitem").where("path <> 'p2'"), ["chapter_title"]),
        f"""{views.WITH_GOODS}, c AS ({for_duckdb(CHOICES)}), k AS (SELECT product, chapter, min(pos) AS pos FROM c WHERE field = 'chapter_title' AND path <> 'p2' AND chapter <> '07' AND chapter IN (SELECT substr(code10, 1, 2) FROM goods) GROUP BY ALL),
        p AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY pos, chapter) AS place FROM k) SELECT product, chapter, place, CASE place WHEN 1 THEN 'selected' ELSE 'alternative' END AS role FROM p WHERE place <= 5""",
    ),
    "promote_rows": (
        lambda s, d: ops.promote_rows(rows(s, d, FACT_ROWS, "lineitem").where("is_fact"), rows(s, d, FACT_ROWS, "lineitem").where("NOT is_fact")),
        f"""WITH r AS (SELECT *, regexp_replace(lower(value), '\\s+', '', 'g') AS k FROM ({for_duckdb(FACT_ROWS)})),
        n AS (SELECT product, k, arg_min(name, pos) AS name, arg_min(value, pos) AS value FROM r WHERE NOT is_fact AND accepted GROUP BY product, k)
        SELECT product, name, value, 'fact' AS origin FROM r WHERE is_fact UNION ALL SELECT product, name, value, 'table_row' FROM n WHERE NOT EXISTS (SELECT 1 FROM r WHERE is_fact AND r.product = n.product AND r.k = n.k)""",
    ),
}
