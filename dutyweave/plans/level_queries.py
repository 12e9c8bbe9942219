"""Registered queries on the level loop, with their SQL twins: goods of the part table down their own code tree."""

from __future__ import annotations

from functools import cache

from pyspark.sql import DataFrame, SparkSession

from dutyweave.operators import levels as ops
from dutyweave.operators.classes import to_members
from dutyweave.plans import views
from dutyweave.staging import stage

NODES = """SELECT DISTINCT substr(code10, 1, w) AS code, substr(code10, 1, w - 2) AS parent, substr(code10, w - 1, 2) = '00' AS residual FROM {goods} CROSS JOIN (SELECT 4 AS w UNION ALL SELECT 6 UNION ALL SELECT 8)"""
CONDITIONS = """SELECT code, row_id, CASE WHEN row_id = 2 AND rep % 2 = 1 THEN '' ELSE 'a' END AS alt_group,
  CASE WHEN row_id = 2 THEN 'brand' WHEN w = 4 THEN 'kind' WHEN w = 6 THEN 'look' ELSE 'thing' END AS field,
  CASE WHEN row_id = 2 THEN p_brand WHEN w = 4 THEN p_type WHEN w = 6 THEN split_part(p_name, ' ', 1) ELSE split_part(p_name, ' ', 2) END AS value
  FROM (SELECT substr(code10, 1, w) AS code, w, min(p_partkey) AS rep FROM {goods} CROSS JOIN (SELECT 4 AS w UNION ALL SELECT 6 UNION ALL SELECT 8) GROUP BY 1, 2)
  JOIN {part} ON p_partkey = rep CROSS JOIN (SELECT 1 AS row_id UNION ALL SELECT 2)"""
FACTS = """SELECT p_partkey AS product, 'kind' AS field, p_type AS value FROM {part} WHERE p_size % 5 <> 0
  UNION ALL SELECT p_partkey, 'look', split_part(p_name, ' ', 1) FROM {part} WHERE p_size % 7 <> 0
  UNION ALL SELECT p_partkey, 'thing', split_part(p_name, ' ', 2) FROM {part} WHERE p_size % 3 <> 0
  UNION ALL SELECT p_partkey, 'brand', p_brand FROM {part} WHERE p_size % 4 <> 0"""
STARTS = """SELECT p_partkey AS product, substr(code10, 1, 2) AS parent FROM {goods}
  UNION ALL SELECT p_partkey, lpad(CAST(CAST(substr(code10, 1, 2) AS INT) % 24 + 1 AS <S>), 2, '0') FROM {goods}"""
PRECEDENTS = """SELECT p_partkey AS product, substr(code10, 1, w) AS code FROM {goods} CROSS JOIN (SELECT 4 AS w UNION ALL SELECT 6 UNION ALL SELECT 8) WHERE p_partkey % 4 = 0"""
INPUTS = {"starts": STARTS, "nodes": NODES, "conditions": CONDITIONS, "facts": FACTS, "precedents": PRECEDENTS}


def inputs(s: SparkSession, d: str) -> list[DataFrame]:
    given = {"part": views.table(s, d, "part"), "goods": views.goods(s, d)}
    return [s.sql(views.for_spark(text), **{k: v for k, v in given.items() if "{" + k + "}" in text}) for text in INPUTS.values()]


def _ranked(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(ranked candidates, explicit matches) of one product of each class, and the members of the classes."""
    starts, nodes, conditions, facts, _ = inputs(s, d)
    nodes, conditions = stage(nodes, "level-nodes"), stage(conditions, "level-conditions")
    parents, known, _, members = ops.alike(starts, nodes, conditions, facts)
    candidates = stage(parents.join(nodes, "parent"), "level-candidates")
    details = stage(ops.detail_verdicts(candidates, conditions, known), "level-details")
    explicit = stage(ops.explicit_matches(details, nodes, conditions), "level-explicit")
    return ops.rank_candidates(candidates, details, explicit), explicit, members


def _explicit(s: SparkSession, d: str) -> DataFrame:
    _, explicit, members = _ranked(s, d)
    return to_members(explicit, members, "product")


def _promoted(s: SparkSession, d: str) -> DataFrame:
    ranked, explicit, members = _ranked(s, d)
    return to_members(stage(ops.promote_residual(ranked, explicit), "level-promoted"), members, "product")


D_INPUTS = f"{views.WITH_GOODS}, " + ", ".join(f"{name} AS ({views.for_duckdb(text)})" for name, text in INPUTS.items())
D_INPUTS += ", known AS (SELECT DISTINCT product, field, value FROM facts), covered AS (SELECT DISTINCT parent, value FROM nodes JOIN conditions USING (code) WHERE residual)"


def _d_rank(name: str, survivors: str) -> str:
    return f"""c{name} AS (SELECT s.product, n.* FROM {survivors} s JOIN nodes n USING (parent)),
    d{name} AS (SELECT c.*, row_id, alt_group, field, value, CASE WHEN (c.product, field) IN (SELECT (product, field) FROM known) THEN (c.product, field, value) IN (SELECT (product, field, value) FROM known) END AS verdict FROM c{name} c JOIN conditions USING (code)),
    x{name} AS (SELECT DISTINCT product, code FROM d{name} WHERE verdict AND NOT residual AND (parent, value) NOT IN (SELECT (parent, value) FROM covered)),
    o{name} AS (SELECT product, code, CASE WHEN alt_group = '' THEN 'row:' || row_id ELSE alt_group END AS g, count_if(verdict) AS t, count_if(NOT verdict) AS f, count(*) AS n FROM d{name} GROUP BY ALL),
    u{name} AS (SELECT product, code, min(CASE WHEN t > 0 THEN 1 WHEN f = n THEN -1 ELSE 0 END) AS x, sum(t) AS met FROM o{name} GROUP BY ALL),
    r{name} AS (SELECT *, CAST(3 * met + CASE decision WHEN 'confirmed' THEN 50 WHEN 'violated' THEN -100 ELSE 0 END AS BIGINT) AS score, met > 0 AS answered FROM (
      SELECT c.product, parent, code, residual, x IS NOT NULL AS asked, coalesce(met, 0) AS met,
        CASE WHEN x = -1 THEN 'violated' WHEN x = 1 AND (residual OR (c.product, code) IN (SELECT (product, code) FROM x{name})) THEN 'confirmed' ELSE 'undecided' END AS decision
      FROM c{name} c LEFT JOIN u{name} USING (product, code))),
    e{name} AS (SELECT *, residual AND score > -50 AND bool_or(asked) OVER w AS viable, bool_or(NOT residual) OVER w AS has_named, bool_or(NOT residual AND score > 0) OVER w AS lead,
      bool_or(NOT residual AND score > 0 AND (product, code) IN (SELECT (product, code) FROM x{name})) OVER w AS proven FROM r{name} WINDOW w AS (PARTITION BY product, parent)),
    f{name} AS (SELECT *, bool_or(viable) OVER w AND has_named AND NOT proven AS promote FROM e{name} WINDOW w AS (PARTITION BY product, parent)),
    g{name} AS (SELECT *, row_number() OVER (PARTITION BY product, parent ORDER BY CASE WHEN promote THEN CASE WHEN viable THEN 0 WHEN NOT residual THEN 1 ELSE 2 END WHEN lead THEN CAST(residual AS INT) ELSE CAST(NOT residual AS INT) END, score DESC, code) AS place FROM f{name}),
    p{name} AS (SELECT product, parent, code, score, place, CASE WHEN promote THEN CASE WHEN viable OR NOT residual THEN 'residual_promoted' END
      WHEN lead AND max(CASE WHEN place = 1 THEN answered END) OVER (PARTITION BY product, parent) THEN CASE WHEN place = 1 THEN 'qualified_named' END ELSE 'unqualified_question' END AS phase FROM g{name})"""


def _d_level(level: int, survivors: str) -> str:
    n, by = level, "product" if level == 4 else "product, parent"
    return f"""{_d_rank(n, survivors)},
    k{n} AS (SELECT *, count(*) OVER w AS n, count_if(NOT residual) OVER w AS ns, count_if(known) OVER w AS nk, max(code) OVER w AS mx FROM (
      SELECT r.*, (product, code) IN (SELECT (product, code) FROM precedents) AS known FROM r{n} r WHERE decision = 'confirmed') WINDOW w AS (PARTITION BY {by})),
    q{n} AS (SELECT product, code FROM k{n} WHERE n > 1 AND CASE WHEN ns = 1 THEN residual WHEN nk = 1 THEN NOT known ELSE {"false" if level == 4 else "code <> mx"} END),
    h{n} AS (SELECT product, count(*) AS candidates, min(code) AS lone, count_if(decision = 'confirmed') AS c, min(CASE WHEN decision = 'confirmed' THEN code END) AS conf, count_if(NOT residual) AS named,
      count_if(NOT residual AND decision = 'violated') AS gone, count_if(residual) AS rest, min(CASE WHEN residual AND decision <> 'violated' THEN code END) AS lft
      FROM (SELECT * REPLACE (CASE WHEN (product, code) IN (SELECT (product, code) FROM q{n}) THEN 'undecided' ELSE decision END AS decision) FROM r{n}) GROUP BY product),
    l{n} AS (SELECT product, arg_max({{'code': code, 'phase': phase}}, {{'s': score, 'c': code}}) AS lead FROM p{n} WHERE place = 1 GROUP BY product),
    w{n} AS (SELECT s.product, {n} AS level, CASE WHEN candidates = 1 THEN lone WHEN c = 1 THEN conf WHEN c = 0 AND named = gone AND rest = 1 THEN lft END AS code,
      CASE WHEN candidates IS NULL THEN 'no_children' WHEN candidates = 1 THEN 'pass_through' WHEN c = 1 THEN 'confirmed' WHEN c > 1 THEN 'several_confirmed'
        WHEN named = gone AND rest = 1 AND lft IS NOT NULL THEN 'residual_by_elimination' ELSE 'open' END AS authority, coalesce(candidates, 0) AS candidates, lead.code AS leader, lead.phase AS phase
      FROM (SELECT DISTINCT product FROM {survivors}) s LEFT JOIN h{n} USING (product) LEFT JOIN l{n} USING (product)),
    s{n} AS (SELECT product, code AS parent FROM w{n} WHERE code IS NOT NULL)"""


@cache
def _d_loop() -> str:
    return f"{D_INPUTS}, first AS (SELECT DISTINCT product, parent FROM starts), {_d_level(4, 'first')}, {_d_level(6, 's4')}, {_d_level(8, 's6')}"


D_RESULT = "SELECT * FROM w4 UNION ALL SELECT * FROM w6 UNION ALL SELECT * FROM w8"
D_SILENT = " UNION ALL ".join(f"SELECT DISTINCT product, {n} AS level, field, value FROM d{n} WHERE verdict IS NULL AND product IN (SELECT product FROM w{n} WHERE code IS NULL)" for n in ops.LEVELS)

QUERIES = {
    "explicit_matches": (_explicit, f"{D_INPUTS}, {_d_rank('', 'starts')} SELECT * FROM x"),
    "promote_residual": (_promoted, f"{D_INPUTS}, {_d_rank('', 'starts')} SELECT product, parent, code, phase, place FROM p"),
    "classify_levels": (lambda s, d: ops.classify_levels(*inputs(s, d))[0], f"{_d_loop()} {D_RESULT}"),
    "level_questions": (
        lambda s, d: ops.questions_of_levels(*inputs(s, d)),
        f"""{_d_loop()}, z AS ({D_SILENT}), k AS (SELECT DISTINCT product, level, field, value, sha256('["' || field || '","' || value || '"]') AS question_key FROM z),
        n AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY question_key) AS place FROM k) SELECT * FROM n WHERE place <= 8""",
    ),
}
