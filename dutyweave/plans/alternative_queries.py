"""Registered queries on alternatives and ingredient lists, with their SQL twins."""

from __future__ import annotations

from dutyweave.operators import alternatives as ops
from dutyweave.operators import classify
from dutyweave.plans import views

W = ["split_part(p_name, ' ', 1)", "split_part(p_name, ' ', 2)", "lower(p_type)", "replace(lower(p_brand), '#', 'ed no')", "'kind' || CAST(p_size % 7 AS <S>)"]
LABELS = f"""SELECT p_partkey AS code, CASE p_partkey % 6 WHEN 0 THEN 'Fruit and nuts, ' || {W[0]} || ' or cooked by ' || {W[1]} || ' OR boiled in ' || {W[2]} || ', frozen' WHEN 1 THEN {W[0]} || ' (' || {W[1]} || ' or ' || {W[2]} || ' ' || {W[3]} || '), fresh or dried'
  WHEN 2 THEN 'Baked ; bread, ' || {W[0]} || ' wares; communion ' || {W[1]} || ', rice ' || {W[2]} || '.' WHEN 3 THEN 'Pasta (' || {W[0]} || '), whether or not ' || {W[1]} || ' or ' || {W[2]} || ', such as ' || {W[3]} || ' or ' || {W[4]}
  WHEN 4 THEN {W[0]} || ' ; whether or not ' || {W[1]} || ' or ' || {W[2]} ELSE p_name END AS label FROM {{part}}"""
VALUES = f"""SELECT p_partkey AS code, CAST(k AS INT) AS row_id, CASE k WHEN 1 THEN {W[0]} WHEN 2 THEN {W[1]} || ' cooked' WHEN 3 THEN upper({W[2]}) WHEN 4 THEN {W[3]} ELSE 'frozen' END AS value,
  CASE (p_size + k) % 3 WHEN 0 THEN true WHEN 1 THEN false END AS verdict FROM {{part}} CROSS JOIN (SELECT 1 AS k UNION ALL SELECT 2 UNION ALL SELECT 3 UNION ALL SELECT 4 UNION ALL SELECT 5)"""
TEXTS = f"""SELECT p_partkey AS text_id, {W[0]} || ' 12.5% (' || {W[1]} || ' 30 %, ' || {W[2]} || ' [' || {W[3]} || ' 5%]), ' || CASE p_partkey % 5 WHEN 0 THEN 'protein 3 %' WHEN 1 THEN {W[1]} || ' origin 100%' WHEN 2 THEN ') ' || {W[4]} || ' 7% 8%' WHEN 3 THEN '[' || {W[4]} || ', 9 %' ELSE ', ，' || {W[4]} END
  || '、' || {W[2]} || ' ' || CAST(p_size AS <S>) || '%' AS text FROM {{part}}"""
ORIGIN, NUTRITION = "origin", "protein"


def _sql(s, d, text):
    return s.sql(views.for_spark(text), part=views.table(s, d, "part"))


def _texts(s, d):
    return _sql(s, d, TEXTS)


def _atoms(s, d):
    return ops.alternation_atoms(_sql(s, d, LABELS))


def _grouped(s, d):
    return ops.group_values(_sql(s, d, VALUES), _atoms(s, d))


D_ATOMS = f"""lab AS ({views.for_duckdb(LABELS)}), ln AS (SELECT code, list_transform(string_split(label, ' ; '), lambda x: trim(regexp_replace(x, '(?i)\\bwhether\\s+or\\s+not\\b.*?(,\\s*such\\s+as\\b|$)', '\\1', 'g'))) AS ls FROM lab),
tx AS (SELECT code, ls[-1] AS leaf, array_to_string(list_filter(ls, lambda x: x <> ''), ' ; ') AS t FROM ln),
br AS (SELECT code, regexp_extract_all(t, '(?i)\\(([^()]*\\bor\\b[^()]*)\\)', 1) AS b, list_filter(regexp_split_to_array(regexp_replace(t, '(?i)\\([^()]*\\bor\\b[^()]*\\)', ',', 'g'), '[,;:()]'), lambda p: regexp_matches(p, '(?i)\\s+or\\s+')) AS r, leaf FROM tx),
ga AS (SELECT code, list_concat(list_transform(b, lambda x: list_transform(regexp_split_to_array(x, '(?i)\\s+or\\s+'), lambda y: lower(trim(y)))), list_filter(list_transform(r, lambda x: list_filter(list_transform(regexp_split_to_array(x, '(?i)\\s+or\\s+'), lambda y: lower(trim(y))), lambda y: y <> '')), lambda z: len(z) >= 2)) AS gs,
  list_filter(list_transform(string_split(leaf, ';'), lambda p: lower(trim(p, ' ,.'))), lambda p: p <> '') AS ss FROM br),
atm AS (SELECT code, 'g' || (k - 1) AS grp, (k - 1) * 1000 + j - 1 AS place, gs[k][j] AS atom FROM (SELECT code, gs, k, unnest(range(1, len(gs[k]) + 1)) AS j FROM (SELECT code, gs, unnest(range(1, len(gs) + 1)) AS k FROM ga)) WHERE gs[k][j] <> ''
  UNION ALL SELECT code, 's0', len(gs) * 1000 + j - 1, ss[j] FROM (SELECT code, gs, ss, unnest(range(1, len(ss) + 1)) AS j FROM ga WHERE len(ss) >= 2))"""
D_GROUPED = f"""{D_ATOMS}, va AS ({views.for_duckdb(VALUES)}), hit AS (SELECT v.code, row_id, grp, place, contains(atom, lower(value)) AS whole FROM va v JOIN atm USING (code)
  WHERE value <> '' AND (contains(atom, lower(value)) OR len(list_filter(string_split(lower(value), ' '), lambda w: length(w) >= 3 AND NOT contains(atom, w))) = 0)),
gv AS (SELECT va.*, coalesce(code || ':' || grp, '') AS alt_group FROM va LEFT JOIN (SELECT * FROM hit QUALIFY row_number() OVER (PARTITION BY code, row_id ORDER BY NOT whole, place) = 1) USING (code, row_id))"""
D_CHARS = f"""tx AS ({views.for_duckdb(TEXTS)}), ch AS (SELECT text_id, i, substr(text, i, 1) AS c FROM (SELECT *, unnest(range(1, length(text) + 1)) AS i FROM tx)),
s1 AS (SELECT *, sum(CASE WHEN c IN ('(', '[', '{{') THEN 1 WHEN c IN (')', ']', '}}') THEN -1 ELSE 0 END) OVER (PARTITION BY text_id ORDER BY i) AS s FROM ch), s2 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY text_id ORDER BY i)) AS depth FROM s1),
s3 AS (SELECT *, c IN (',', '，', '、') AND depth = 0 AS ends FROM s2), s4 AS (SELECT *, coalesce(sum(CAST(ends AS INT)) OVER (PARTITION BY text_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS segment FROM s3),
sg AS (SELECT text_id, CAST(segment AS INT) AS segment, trim(regexp_replace(string_agg(CASE WHEN depth = 0 AND NOT ends AND c NOT IN (')', ']', '}}') THEN c ELSE ' ' END, '' ORDER BY i), '\\s+', ' ', 'g')) AS head,
  string_agg(CASE WHEN depth > 0 AND c NOT IN ('(', '[', '{{', ')', ']', '}}') THEN CASE WHEN c = ',' THEN ' , ' ELSE c END ELSE ' ' END, '' ORDER BY i) AS inner_, max(CAST(c NOT IN (' ', '(', '[', ')', ']') AND NOT ends AS INT)) AS filled FROM s4 GROUP BY ALL),
se AS (SELECT text_id, segment, trim(regexp_replace(regexp_replace(head, '(\\d+(?:[.,]\\d+)?)\\s*%', ' ', 'g'), '\\s+', ' ', 'g')) AS name, regexp_extract_all(head, '(\\d+(?:[.,]\\d+)?)\\s*%', 1) AS top, regexp_extract_all(inner_, '(\\d+(?:[.,]\\d+)?)\\s*%', 1) AS nested FROM sg WHERE filled = 1),
sr AS (SELECT *, CASE WHEN contains(name, 'protein') THEN 'nutrition' WHEN contains(name, 'origin') THEN 'origin' END AS reason FROM se)"""

QUERIES = {
    "alternation_atoms": (_atoms, f"WITH {D_ATOMS} SELECT code, grp, place, atom FROM atm"),
    "grouped_values": (lambda s, d: _grouped(s, d).drop("verdict"), f"WITH {D_GROUPED} SELECT code, row_id, value, alt_group FROM gv"),
    "grouped_decisions": (
        lambda s, d: classify.roll_up(_grouped(s, d), ["code"]),
        f"""WITH {D_GROUPED}, o AS (SELECT code, CASE WHEN alt_group = '' THEN 'row:' || row_id ELSE alt_group END AS g, count_if(verdict) AS t, count_if(NOT verdict) AS f, count(*) AS n FROM gv GROUP BY ALL), u AS (SELECT code, CASE WHEN t > 0 THEN 1 WHEN f = n THEN -1 ELSE 0 END AS x FROM o)
        SELECT code, CASE WHEN min(x) = -1 THEN 'violated' WHEN min(x) = 1 THEN 'confirmed' ELSE 'undecided' END AS decision FROM u GROUP BY code""",
    ),
    "split_ingredients": (lambda s, d: ops.split_ingredients(_texts(s, d), ORIGIN, NUTRITION), f"WITH {D_CHARS} SELECT text_id, segment, name, CASE WHEN reason IS NULL THEN CAST(top[1] AS DOUBLE) END AS percent FROM sr"),
    "excluded_percents": (
        lambda s, d: ops.excluded_percents(_texts(s, d), ORIGIN, NUTRITION),
        f"WITH {D_CHARS} SELECT text_id, segment, CAST(unnest(CASE WHEN reason IS NULL THEN top[2:] ELSE top END) AS DOUBLE) AS percent, coalesce(reason, 'repeated') AS reason FROM sr UNION ALL SELECT text_id, segment, CAST(unnest(nested) AS DOUBLE), 'nested' FROM sr",
    ),
}
