"""Registered queries on the conditions that labels are compiled to, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from dutyweave.operators import conditions as ops
from dutyweave.plans import views
from dutyweave.plans.text_queries import D_STEM

W = ["split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)", "lower(p_type)"]
LABELS = f"""SELECT p_partkey % 40 AS family, p_partkey AS code, CASE p_partkey % 8 WHEN 0 THEN 'Machines, frozen ; of ' || {W[1]} || ' containing ' || {W[2]} || ' and ' || {W[0]} || ' stone, fresh, dried'
  WHEN 1 THEN {W[0]} || ' ' || {W[1]} || ', not exceeding 5 kg' WHEN 2 THEN 'Parts of machines ; ' || {W[1]} || ' for infants, weighing more than ' || CAST(p_size AS <S>) || ' g' WHEN 3 THEN 'Plastic plates ; Other'
  WHEN 4 THEN {W[1]} || ' (' || {W[0]} || ' or ' || {W[2]} || '), smoked; salted' WHEN 5 THEN 'Goods ; Used' WHEN 6 THEN {W[0]} || ' articles of ' || {W[1]} || ' wood, dried' ELSE 'Paper sheets ; ' || {W[0]} || ' or ' || {W[1]} || ', wooden ' || {W[2]} END AS label FROM {{part}}"""
PATTERNS = [
    ops.Pattern("preservation_state", "state", r"\b(?:frozen|fresh|dried|smoked)\b"),
    ops.Pattern("condition_quality", "state", r"\bused\b"),
    ops.Pattern("species_source", "noun", r"\b(?:infants|smoked)\b"),
    ops.Pattern("material_composition", "operator", r"\b(?:containing|articles of)\b"),
    ops.Pattern("physical_form", "state", r"\b(?:sheets?|plates?)\b"),
    ops.Pattern("quantitative_threshold", "quantity", r"\b(?:weighing|exceeding)\b"),
]
STOP, STATES = ["for", "used", "article", "weighing", "than", "more"], ["frozen", "fresh", "dried"]
SETS = {"state_set": ("preservation_state", ["preservation_state"], ["frozen", "fresh", "dried", "smoked"]), "form_set": ("physical_form", ["physical_form"], ["sheet", "plate"])}
NOTES = f"""SELECT l_partkey AS code, CASE l_linenumber % 3 WHEN 0 THEN 'note_excl' WHEN 1 THEN 'rule_excl' ELSE 'note_incl' END AS kind, l_orderkey * 10 + l_linenumber AS pos,
  CASE l_suppkey % 4 WHEN 0 THEN 'This heading does not cover ' || {W[0]} || ' leather ' || l_suppkey || ', or iron ' || l_orderkey || '.' WHEN 1 THEN 'It excludes: cotton ' || l_suppkey || ' and ' || {W[1]} || ' glass; not more' WHEN 2 THEN 'Excluding less than, wool, silk ' || l_suppkey || ' thread' ELSE 'such ' || {W[1]} || ' rods, or tubes ' || l_suppkey || ' and pipes, bars' END AS text
  FROM (SELECT DISTINCT l_partkey, l_linenumber, l_orderkey, l_suppkey FROM {{lineitem}}) JOIN {{part}} ON p_partkey = l_partkey"""
IDLE = ["and", "the", "such", "this", "heading"]


def _sql(s, d, text):
    names = [n for n in ("part", "lineitem") if "{" + n + "}" in text]
    return s.sql(views.for_spark(text), **{n: views.table(s, d, n) for n in names})


def _parts(s, d):
    return ops.label_parts(_sql(s, d, LABELS))


def _typed(s, d):
    return ops.typed_conditions(_parts(s, d), PATTERNS, STOP, STATES)


def _list(words):
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _units(text, leave, most=4, first=8):
    words = f"list_filter(list_transform(regexp_extract_all(s, '[a-z0-9]+'), lambda w: {D_STEM}), lambda x: length(x) >= 3 AND NOT list_contains({leave}, x))"
    every = f"list_filter(list_transform(string_split_regex(lower({text}), '[,;:()]|\\band\\b|\\bor\\b'), lambda s: array_to_string(list_slice({words}, 1, {most}), ' ')), lambda u: u <> '')"
    return f"list_slice(list_filter({every}, lambda u, i: list_position({every}, u) = i), 1, {first})"  # each phrase once, at its first place


def _stems(text):
    return f"list_distinct(list_transform(regexp_extract_all(lower({text}), '[a-z0-9]+'), lambda w: {D_STEM}))"


DENY = "(?i)\\b(?:other\\s+than|excluding|except|does\\s+not\\s+include|not\\s+including|not\\s+containing|without|no|not)\\s+([a-z][a-z ,\\-]{2,60}[a-z]*)"
D_PARTS = f"""lab AS ({views.for_duckdb(LABELS)}), l0 AS (SELECT family, code, label, string_split(label, ' ; ') AS ls, {_stems('label')} AS ws FROM lab), l1 AS (SELECT *, ls[-1] AS leaf, array_to_string(ls[:-2], ' ; ') AS ancestor FROM l0),
nf AS (SELECT family, count(*) AS n FROM l1 GROUP BY 1), wf AS (SELECT family, w, count(*) AS df FROM (SELECT family, unnest(ws) AS w FROM l1) GROUP BY ALL),
cm AS (SELECT family, list(w) AS common FROM wf JOIN nf USING (family) WHERE df - 1 > greatest(1, n - 1) / 2 GROUP BY 1), lu AS (SELECT DISTINCT family, unnest({_stems('leaf')}) AS w FROM l1),
av AS (SELECT code, list(w) AS above FROM (SELECT family, code, unnest({_stems('ancestor')}) AS w FROM l1 WHERE ancestor <> '') a WHERE NOT EXISTS (SELECT 1 FROM lu WHERE lu.family = a.family AND lu.w = a.w) GROUP BY 1),
pt AS (SELECT l1.family, l1.code, label, leaf, ancestor, regexp_replace(label, '{DENY}', ' ', 'g') AS pos, regexp_replace(leaf, '{DENY}', ' ', 'g') AS lpos, coalesce(above, []) AS above, coalesce(common, []) AS common, leaf = 'Other' AS residual FROM l1 LEFT JOIN cm USING (family) LEFT JOIN av USING (code))"""
STATE_RX, FORM_RX = "(?i)\\b(?:frozen|fresh|dried|smoked)\\b", "(?i)\\b(?:sheets?|plates?)\\b"
CUT = "\\b(?:frozen|fresh|dried|smoked|used|sheets?|plates?)\\b"
IDLE_SQL = f"list_concat({_list(STOP)}, common)"
NOUN_SQL = f"list_concat({IDLE_SQL}, above, {_list(STATES)})"
D_TYPED = f"""{D_PARTS}, sp AS (SELECT *, regexp_extract(pos, '{STATE_RX}') AS m1, regexp_extract(pos, '(?i)\\bused\\b') AS m2, regexp_extract(lpos, '(?i)\\b(?:infants|smoked)\\b') AS m3, regexp_extract(lpos, '(?i)\\b(?:containing|articles of)\\b') AS m4,
  string_split(regexp_extract(lpos, '(?i)\\b(?:containing|articles of)\\b(.*)', 1), ';')[1] AS after_, regexp_extract(pos, '{FORM_RX}') AS m5 FROM pt WHERE NOT residual),
cut AS (SELECT *, CASE WHEN regexp_matches(after_, '{CUT}') THEN regexp_extract(after_, '(?i)^(.*?)' || '{CUT}', 1) ELSE after_ END AS span FROM sp),
ty AS (SELECT family, code, 'preservation_state' AS axis, 'has_token' AS op, {_units('m1', IDLE_SQL)} AS words, m1 AS source FROM cut WHERE m1 <> '' UNION ALL SELECT family, code, 'condition_quality', 'has_token', {_units('m2', IDLE_SQL)}, m2 FROM cut WHERE m2 <> ''
  UNION ALL SELECT family, code, CASE m3 WHEN 'smoked' THEN 'preservation_state' ELSE 'species_source' END, 'has_token', {_units('m3', NOUN_SQL)}, m3 FROM cut WHERE m3 <> ''
  UNION ALL SELECT family, code, 'material_composition', 'has_token', {_units('span', NOUN_SQL)}, m4 || span FROM cut WHERE m4 <> '' UNION ALL SELECT family, code, 'physical_form', 'has_token', {_units('m5', IDLE_SQL)}, m5 FROM cut WHERE m5 <> ''),
td AS (SELECT family, code, axis, op, array_to_string(words, '|') AS words, source FROM ty WHERE len(words) > 0 UNION ALL SELECT family, code, 'quantitative_threshold', 'quant_gate', NULL, label FROM pt WHERE regexp_matches(pos, '\\b(?:weighing|exceeding)\\b') UNION ALL SELECT family, code, 'quantitative_threshold', 'quant_gate', NULL, leaf FROM pt WHERE contains(label, 'not exceeding'))"""
# the groups of the two kinds of labels that hold alternatives, said by what their atoms are
ATOMS = f"""SELECT p_partkey AS code, 'g0' AS grp, unnest([{W[0]}, {W[2]}]) AS atom, unnest([0, 1]) AS place FROM part WHERE p_partkey % 8 = 4 UNION ALL SELECT p_partkey, 's0', unnest([{W[1]} || ' (' || {W[0]} || ' or ' || {W[2]} || '), smoked', 'salted']), unnest([1000, 1001]) FROM part WHERE p_partkey % 8 = 4
  UNION ALL SELECT p_partkey, 'g0', unnest([{W[0]}, {W[1]}]), unnest([0, 1]) FROM part WHERE p_partkey % 8 = 7"""
D_FALLBACK = f"""{D_TYPED}, nm AS (SELECT code, bool_or(axis IN ('product_identity', 'species_source')) AS named, list_distinct(flatten(list(string_split(replace(coalesce(words, ''), '|', ' '), ' ')))) AS own FROM td GROUP BY 1),
op AS (SELECT pt.*, own IS NOT NULL AS typed, coalesce(own, []) AS own FROM pt LEFT JOIN nm USING (code) WHERE NOT residual AND NOT coalesce(named, false)),
un AS (SELECT family, code, typed, lpos, common, above, {_units('lpos', f'list_concat({NOUN_SQL}, own)')} AS units FROM op), uu AS (SELECT family, code, u, min(i) AS i FROM (SELECT family, code, unnest(units) AS u, unnest(range(1, len(units) + 1)) AS i FROM un) GROUP BY ALL),
atm AS ({ATOMS}), hit AS (SELECT uu.*, coalesce(grp, '') AS alt_group FROM uu LEFT JOIN atm ON atm.code = uu.code AND (contains(atom, u) OR len(list_filter(string_split(u, ' '), lambda w: length(w) >= 3 AND NOT contains(atom, w))) = 0)
  QUALIFY row_number() OVER (PARTITION BY uu.code, i ORDER BY coalesce(NOT contains(atom, u), false), place) = 1),
fb AS (SELECT family, code, 'product_identity' AS axis, string_agg(u, '|' ORDER BY i) AS words, alt_group, 'fallback' AS grade FROM hit GROUP BY family, code, alt_group
  UNION ALL SELECT family, code, 'condition_quality', 'used', '', 'named' FROM un WHERE lpos = 'Used' AND NOT typed AND len(units) = 0 AND NOT list_contains(common, 'used') AND NOT list_contains(above, 'used'))"""
NOTE_UNITS = "list_slice(list_filter(list_transform(string_split_regex({t}, '[,;:()]|\\bor\\b|\\band\\b'), lambda s: array_to_string(list_slice(list_transform(list_filter(regexp_extract_all(lower(s), '[a-z0-9]+'), lambda w: length(w) >= 3 AND NOT list_contains({idle}, w)), lambda w: {stem}), 1, 3), ' ')), lambda u: u <> ''), 1, {n})"


def _note_units(t, n):
    return NOTE_UNITS.format(t=t, n=n, idle=_list(IDLE), stem=D_STEM)


D_NOTES = f"""{D_PARTS}, nt AS (SELECT code, kind, text, row_number() OVER (PARTITION BY code, kind ORDER BY pos, text) AS k FROM ({views.for_duckdb(NOTES)})),
cl AS (SELECT code, kind, k, unnest(ts) AS t, generate_subscripts(ts, 1) AS c FROM (SELECT *, regexp_extract_all(text, '(?i)(?:does not cover|do not cover|excludes?|excluding|are not included|is not included|not covered by)[:\\s]+([^.;(]{{4,90}})', 1) AS ts FROM nt WHERE kind <> 'note_incl' AND k <= 4)),
ex AS (SELECT code, kind, k, c, unnest({_note_units('t', 2)}) AS u, unnest(range(1, 3)) AS i FROM cl),
ok AS (SELECT family, ex.code, kind, k, c, i, u FROM ex JOIN pt USING (code) WHERE u IS NOT NULL AND contains(u, ' ') AND NOT list_has_any(string_split(u, ' '), list_filter({_stems('leaf')}, lambda x: length(x) >= 3)) AND NOT regexp_matches(u, '^(less|than| )+$')),
f1 AS (SELECT family, code, kind, u, min((k, c, i)) AS p FROM ok GROUP BY ALL),
-- a note is read while its kind's phrases so far, with those read of the kind before, are fewer than four; the first of each kind always
e2 AS (SELECT *, p[1] AS k FROM f1 WHERE kind = 'note_excl'), er AS (SELECT a.family, a.code, a.u, a.p FROM e2 a WHERE a.k = 1 OR (SELECT count(*) FROM e2 b WHERE b.code = a.code AND b.k < a.k) < 4),
-- a phrase of an unread note was not met, so the next kind may bring it
r2 AS (SELECT *, p[1] AS k FROM f1 WHERE kind = 'rule_excl' AND NOT EXISTS (SELECT 1 FROM er WHERE er.code = f1.code AND er.u = f1.u)), ec AS (SELECT code, count(*) AS n FROM er GROUP BY code),
rr AS (SELECT a.family, a.code, a.u, a.p FROM r2 a WHERE a.k = 1 OR coalesce((SELECT n FROM ec WHERE ec.code = a.code), 0) + (SELECT count(*) FROM r2 b WHERE b.code = a.code AND b.k < a.k) < 4),
kept AS (SELECT family, code, u, 0 AS kind, p FROM er UNION ALL SELECT family, code, u, 1, p FROM rr)"""

QUERIES = {
    "typed_conditions": (lambda s, d: _typed(s, d).withColumn("words", F.array_join("words", "|")), f"WITH {D_TYPED} SELECT family, code, axis, op, words, source FROM td"),
    "label_qualifiers": (
        lambda s, d: ops.qualifiers(_parts(s, d), PATTERNS, SETS, STOP).withColumn("words", F.array_join("words", "|")),
        f"""WITH {D_PARTS} SELECT family, code, 'product_identity' AS axis, 'ancestor' AS kind, array_to_string(w, '|') AS words FROM (SELECT *, {_units('ancestor', _list(STOP))} AS w FROM pt WHERE ancestor <> '') WHERE len(w) > 0
        UNION ALL SELECT family, code, axis, kind, string_agg(DISTINCT x, '|' ORDER BY x) FROM (SELECT family, code, axis, kind, {D_STEM} AS x FROM (SELECT family, code, 'preservation_state' AS axis, 'state_set' AS kind, lower(unnest(regexp_extract_all(pos, '{STATE_RX}'))) AS w FROM pt WHERE NOT residual
          UNION ALL SELECT family, code, 'physical_form', 'form_set', lower(unnest(regexp_extract_all(pos, '{FORM_RX}'))) FROM pt WHERE NOT residual)) GROUP BY ALL""",
    ),
    "fallback_identity": (
        lambda s, d: ops.fallback_identity(_parts(s, d), _typed(s, d), _sql(s, d, LABELS), PATTERNS, STOP, STATES).withColumn("words", F.array_join("words", "|")),
        f"WITH {D_FALLBACK} SELECT family, code, axis, words, alt_group, grade FROM fb",
    ),
    "note_conditions": (
        lambda s, d: ops.note_conditions(_sql(s, d, NOTES), _parts(s, d), IDLE),
        f"""WITH {D_NOTES} SELECT family, code, 'exclusion' AS kind, u AS phrase, row_number() OVER (PARTITION BY code ORDER BY kind, p) - 1 AS place FROM kept
        UNION ALL SELECT family, code, 'inclusion', u, row_number() OVER (PARTITION BY code ORDER BY p) - 1 FROM (SELECT family, code, u, min(k * 10 + i) AS p FROM (SELECT code, k, unnest({_note_units('text', 3)}) AS u, unnest(range(1, 4)) AS i FROM nt WHERE kind = 'note_incl' AND k <= 2) JOIN pt USING (code) WHERE u IS NOT NULL AND NOT residual GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY code ORDER BY p) <= 3""",
    ),
}
