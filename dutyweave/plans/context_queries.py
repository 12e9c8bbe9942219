"""Registered queries on contexts of headings, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import functions as F

from dutyweave.operators import context as ops
from dutyweave.plans import views

W = ["split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)"]
LABELS = f"""SELECT p_partkey AS code, CASE p_partkey % 8 WHEN 0 THEN 'Uncooked ' || {W[1]} || ', not stuffed' WHEN 1 THEN {W[0]} || ', fresh, chilled or frozen' WHEN 2 THEN {W[1]} || ', whole or in pieces'
  WHEN 3 THEN 'Cooked ' || {W[1]} || ', minced' WHEN 4 THEN {W[0]} || ', not cut or otherwise prepared' WHEN 5 THEN 'Other' WHEN 6 THEN 'whether or not stuffed' ELSE {W[0]} || ' ' || {W[1]} END AS label FROM {{part}}""".replace("", "")
ASKS = "SELECT DISTINCT l_orderkey AS product, l_partkey AS code FROM {lineitem}"
# what a product's fields hold, taken from its lines: the first names it, each line tells of a state, a form, or preparation
BOUND = f"""SELECT product, axis, min(status) AS status, min(tokens) AS tokens FROM (SELECT l_orderkey AS product, 'product_identity' AS axis, CASE WHEN l_orderkey % 5 = 0 THEN 'empty' ELSE 'answered' END AS status, {W[0]} || ' ' || {W[1]} AS tokens FROM {{lineitem}} JOIN {{part}} ON p_partkey = l_partkey WHERE l_linenumber = 1
  UNION ALL SELECT l_orderkey, 'processing_method', 'answered', CASE l_suppkey % 4 WHEN 0 THEN 'cooked' WHEN 1 THEN 'uncooked' WHEN 2 THEN 'cook require cooking' ELSE 'roasted' END FROM {{lineitem}} WHERE l_linenumber = 2
  UNION ALL SELECT l_orderkey, 'preservation_state', 'answered', CASE l_suppkey % 3 WHEN 0 THEN 'frozen' WHEN 1 THEN 'dried' ELSE 'salted' END FROM {{lineitem}} WHERE l_linenumber = 3
  UNION ALL SELECT l_orderkey, 'physical_form', 'answered', CASE l_suppkey % 4 WHEN 0 THEN 'whole' WHEN 1 THEN 'minced' WHEN 2 THEN 'whole puree' ELSE 'slice' END FROM {{lineitem}} WHERE l_linenumber = 4) GROUP BY product, axis"""
TEXTS = """SELECT l_orderkey AS product, 'physical_form' AS axis, CASE l_partkey % 4 WHEN 0 THEN 'not stuffed' WHEN 1 THEN 'filled parcel' WHEN 2 THEN 'whether or not stuffed' ELSE 'flat' END AS value FROM {lineitem} WHERE l_linenumber >= 5
  UNION ALL SELECT l_orderkey, 'otherwise_prepared', CASE l_partkey % 4 WHEN 0 THEN 'pre-cooked' WHEN 1 THEN 'not cut or otherwise_prepared' WHEN 2 THEN 'unprepared' ELSE 'raw' END FROM {lineitem} WHERE l_linenumber IN (1, 5)"""
WRAPPERS = "SELECT l_orderkey AS product, l_suppkey % 2 = 0 AS wrapper FROM {lineitem} WHERE l_linenumber = 6"
TAXA = "SELECT l_orderkey AS product, l_partkey AS code, CASE l_suppkey % 3 WHEN 0 THEN 'O' WHEN 1 THEN 'X' ELSE 'SILENCE' END AS verdict FROM {lineitem}"


def _sql(s, d, text):
    names = [n for n in ("part", "lineitem") if "{" + n + "}" in text]
    return s.sql(views.for_spark(text), **{n: views.table(s, d, n) for n in names})


def _verdicts(s, d):
    signs = ops.product_signs(_sql(s, d, BOUND), _sql(s, d, TEXTS), _sql(s, d, WRAPPERS))
    return ops.context_verdicts(_sql(s, d, ASKS), _sql(s, d, LABELS), signs, _sql(s, d, TAXA))


D_CLAUSES = f"""lab AS ({views.for_duckdb(LABELS)}), lw AS (SELECT code, lower(label) AS t, list_sort(list_distinct(regexp_extract_all(replace(lower(label), '-', ' '), '[a-z]+'))) AS ws FROM lab), one AS (SELECT code, t, unnest(ws) AS w FROM lw),
rest AS (SELECT code, list(w ORDER BY w) AS ws FROM one WHERE w NOT IN ({", ".join(repr(w) for w in ops.PROCESSING + ops.PRESERVATION + ops.FORMS + ops.LEGAL + ops.LEFT_OVER)}) GROUP BY code),
kinds AS (SELECT code, w, CASE WHEN contains(t, 'whether or not') THEN 'lapsed' WHEN regexp_matches(t, '\\b(not|non|without)[ -]+' || w || '\\b') THEN 'not' ELSE 'yes' END AS e, contains(t, ' or ') AS ored FROM one WHERE w IN ('stuffed', 'filled', 'minced', 'ground', 'whole', 'piece', 'pieces')),
cl AS (SELECT code, 'processing_method' AS axis, 'yes' AS expected, [w] AS words FROM one WHERE w IN ('cooked', 'uncooked')
  UNION ALL SELECT code, 'preservation_state', 'yes', list(w ORDER BY w) FROM one WHERE w IN ('fresh', 'chilled', 'frozen', 'dried', 'smoked') GROUP BY code
  UNION ALL SELECT code, 'physical_form', 'one_of', list(w ORDER BY w) FROM kinds WHERE e = 'yes' AND ored GROUP BY code HAVING count(*) > 1
  UNION ALL SELECT code, 'physical_form', e, [w] FROM (SELECT *, count(*) FILTER (e = 'yes') OVER (PARTITION BY code) AS n FROM kinds) WHERE e = 'not' OR e = 'yes' AND NOT (ored AND n > 1)
  UNION ALL SELECT code, 'otherwise_prepared', CASE WHEN regexp_matches(t, '\\bnot\\b[^,;]{{0,48}}\\botherwise\\s+prepared\\b') THEN 'not' ELSE 'yes' END, ['otherwise prepared'] FROM lw WHERE regexp_matches(t, '\\botherwise\\s+prepared\\b')
  UNION ALL SELECT code, 'product_identity', 'yes', ws FROM rest),
cls AS (SELECT * FROM cl UNION ALL SELECT code, 'branch_context', CASE WHEN t = 'other' THEN 'no_gate' ELSE 'open' END, [] FROM lw WHERE code NOT IN (SELECT code FROM cl))"""
FORM_ROW = """CASE WHEN {same} AND {other} THEN 'SILENCE' WHEN {same} THEN 'O' WHEN {other} THEN 'X' WHEN x NOT IN ('stuffed', 'filled') THEN 'SILENCE' WHEN yes AND no_ THEN 'SILENCE'
  WHEN yes THEN CASE WHEN wrapper IS FALSE THEN 'SILENCE' ELSE 'O' END WHEN no_ THEN CASE WHEN wrapper THEN 'SILENCE' ELSE 'X' END ELSE 'SILENCE' END"""
SAME = "(x = 'whole' AND list_contains(ft, 'whole') OR x = 'minced' AND list_has_any(ft, ['minced', 'ground', 'paste', 'puree']))"
OTHER = "(x IN ('whole', 'pieces') AND list_has_any(ft, ['minced', 'ground', 'paste', 'puree']) OR x = 'minced' AND list_has_any(ft, ['whole', 'piece', 'pieces', 'portion', 'fillet']))"
D_CONDITIONS = f"""WITH {D_CLAUSES}, ak AS ({views.for_duckdb(ASKS)}), bo AS ({views.for_duckdb(BOUND)}), te AS ({views.for_duckdb(TEXTS)}), wr AS (SELECT product, bool_or(wrapper) AS wrapper FROM ({views.for_duckdb(WRAPPERS)}) GROUP BY 1),
ta AS (SELECT product, code, CASE WHEN min(verdict) = max(verdict) THEN min(verdict) END AS taxon FROM ({views.for_duckdb(TAXA)}) GROUP BY ALL),
sg AS (SELECT product, coalesce(bool_or(value = 'filled parcel'), false) AS yes, coalesce(bool_or(value = 'not stuffed'), false) AS no_, bool_or(value = 'pre-cooked') AS pre, bool_or(value IN ('unprepared', 'not cut or otherwise_prepared')) AS unp FROM te GROUP BY 1),
ax AS (SELECT product, max(tokens) FILTER (axis = 'product_identity' AND status = 'answered') AS pi, max(tokens) FILTER (axis = 'processing_method') AS pm, max(tokens) FILTER (axis = 'preservation_state') AS ps, coalesce(string_split(max(tokens) FILTER (axis = 'physical_form'), ' '), []) AS ft FROM bo GROUP BY 1),
j AS (SELECT ak.product, ak.code, c.axis, expected, words, pi, pm, ps, ft, coalesce(yes, false) AS yes, coalesce(no_, false) AS no_, coalesce(pre, false) AS pre, coalesce(unp, false) AS unp, wrapper, taxon FROM ak JOIN cls c USING (code) LEFT JOIN ax USING (product) LEFT JOIN sg USING (product) LEFT JOIN wr USING (product) LEFT JOIN ta ON ta.product = ak.product AND ta.code = ak.code),
fv AS (SELECT product, code, axis, expected, words, bool_or(v = 'O') AS any_o, bool_and(v = 'X') AS all_x, min(v) AS v FROM (SELECT *, {FORM_ROW.format(same=SAME, other=OTHER)} AS v FROM (SELECT *, unnest(words) AS x FROM j WHERE axis = 'physical_form')) GROUP BY ALL),
raw AS (SELECT product, code, axis, expected, words, CASE axis
    WHEN 'processing_method' THEN CASE WHEN pm IS NULL OR pm = 'roasted' THEN 'SILENCE' WHEN (pm = 'cooked') = (words[1] = 'cooked') THEN 'O' ELSE 'X' END
    WHEN 'preservation_state' THEN CASE WHEN ps IS NULL THEN 'SILENCE' WHEN list_contains(words, ps) THEN 'O' ELSE 'X' END
    WHEN 'otherwise_prepared' THEN CASE WHEN pre = unp THEN 'SILENCE' WHEN pre THEN 'O' ELSE 'X' END
    WHEN 'product_identity' THEN CASE WHEN list_has_all(string_split(pi, ' '), words) THEN 'O' WHEN taxon IN ('O', 'X') THEN taxon ELSE 'SILENCE' END
    ELSE CASE expected WHEN 'no_gate' THEN 'O' ELSE 'SILENCE' END END AS v FROM j WHERE axis <> 'physical_form'
  UNION ALL SELECT product, code, axis, expected, words, CASE WHEN expected <> 'one_of' THEN v WHEN any_o THEN 'O' WHEN all_x THEN 'X' ELSE 'SILENCE' END FROM fv),
cond AS (SELECT product, code, axis, expected, array_to_string(words, ' ') AS value, CASE WHEN expected = 'not' AND v = 'O' THEN 'X' WHEN expected = 'not' AND v = 'X' THEN 'O' ELSE v END AS verdict FROM raw)"""

QUERIES = {
    "context_clauses": (
        lambda s, d: ops.context_clauses(_sql(s, d, LABELS)).select("code", F.explode("clauses").alias("c")).select("code", "c.axis", "c.expected", F.array_join("c.words", " ").alias("value")),
        f"WITH {D_CLAUSES} SELECT code, axis, expected, array_to_string(words, ' ') AS value FROM cls",
    ),
    "context_conditions": (
        lambda s, d: _verdicts(s, d).select("product", "code", F.explode("conditions").alias("c")).select("product", "code", "c.axis", "c.expected", "c.value", "c.verdict"),
        f"{D_CONDITIONS} SELECT product, code, axis, expected, value, verdict FROM cond",
    ),
    "context_verdicts": (
        lambda s, d: _verdicts(s, d).select("product", "code", "verdict", "reason"),
        f"""{D_CONDITIONS}, g AS (SELECT product, code, bool_or(verdict = 'X') AS x, bool_and(verdict = 'O') AS o, bool_or(expected = 'one_of') AS m, max(CASE WHEN axis = 'branch_context' THEN expected END) AS own FROM cond GROUP BY ALL)
        SELECT product, code, CASE WHEN x THEN 'X' WHEN o AND NOT m THEN 'O' ELSE 'SILENCE' END AS verdict, CASE WHEN own = 'no_gate' THEN 'residual_context_no_gate' WHEN own = 'open' THEN 'context_clause_coverage_incomplete' WHEN x THEN 'context_condition_violated'
          WHEN m THEN 'context_clause_coverage_incomplete' WHEN o THEN 'all_context_conditions_confirmed' ELSE 'context_condition_unanswered' END AS reason FROM g""",
    ),
}
