"""Registered queries on papers, votes of rulings and names, with their SQL twins."""

from __future__ import annotations

from dutyweave.operators import papers, votes
from dutyweave.plans import views
from dutyweave.plans.binding_queries import case
from pyspark.sql import functions as F

TABLES = ("part", "lineitem", "supplier", "orders", "customer", "documents", "pages", "benchmark")


def rows(s, d, text):
    used = {t: views.table(s, d, t) for t in TABLES if "{" + t + "}" in text}
    return s.sql(text.replace("<S>", "STRING"), **used)


def duck(text):
    for t in TABLES:
        text = text.replace("{" + t + "}", t)
    return text.replace("<S>", "VARCHAR")


LINES = "SELECT l_orderkey AS form, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity) AS INT) AS line, l_partkey, l_suppkey FROM {lineitem}"
COA_CELLS = f"""SELECT form, line, 0 AS pos, {case(["acetone", "  x", "Ethanol 99", " 64-17-5 ", ""], "l_partkey")} AS text FROM ({LINES})
UNION ALL SELECT form, line, 1, {case(["67-64-1", "no number", "CAS 64-17-5", "12345-67-8 (95,5 %)"], "l_suppkey")} FROM ({LINES})
UNION ALL SELECT form, line, 2, {case(["99.5 %", "", "7 %"], "l_partkey")} FROM ({LINES})"""
INCI_CELLS = """SELECT p_partkey AS form, 1 AS line, 0 AS pos, p_name || ', ' || p_brand || ', x,, ' || p_type AS text FROM {part}
UNION ALL SELECT p_partkey, 1, 1, CASE p_partkey % 3 WHEN 0 THEN 'Ingredients : aqua, glycerin, , parfum, a, citral, ' || p_name WHEN 1 THEN 'short, list' ELSE '가나다라마바사, 아자차카타파하, 나나나나나, 다다다다다, 라라라라라, 마마마마마' END FROM {part}
UNION ALL SELECT p_partkey, 2, 0, CASE WHEN p_partkey % 2 = 0 THEN 'q, r, s, t, u' ELSE 'one, two, three, four, ' || p_brand END FROM {part}"""
SECTIONS = ["Filling", "", "Dough", "  "]
ITEMS = ["rice", "", "white  sugar", "water", "salt"]
SHARES = ["40 %", "0.5", "12,5", "-", "0,25"]
HEADINGS = {0: ["Product name", "x", ""], 1: ["Ingredient", "ingredient", "nothing"], 2: ["Content (%)", "content", "x"], 3: ["Origin", "origin", "y"]}
SHEET_CELLS = " UNION ALL ".join(
    f"SELECT o_orderkey AS form, 'A' AS sheet, 0 AS line, {pos} AS pos, {case(h, 'o_orderkey')} AS text FROM {{orders}} UNION ALL SELECT form, 'A', line, {pos}, {case(items, by)} FROM ({LINES})"
    for (pos, h), (items, by) in zip(HEADINGS.items(), [(SECTIONS, "l_partkey"), (ITEMS, "l_suppkey"), (SHARES, "l_partkey"), (["KR", ""], "l_suppkey")], strict=True)
) + " UNION ALL SELECT o_orderkey, '예시', 1, 0, 'Product name' FROM {orders}"
D_SHEET = f"""WITH l AS ({duck(LINES)}), h AS (SELECT o_orderkey AS form, o_orderkey % 3 AS kind FROM orders WHERE o_orderkey % 3 < 2),
a AS (SELECT form, line, CASE WHEN kind = 0 THEN trim({case(SECTIONS, "l_partkey")}) ELSE '' END AS sec, regexp_replace({case(ITEMS, "l_suppkey")}, ' +', ' ') AS ingredient, TRY_CAST(nullif(replace(regexp_extract({case(SHARES, "l_partkey")}, '[0-9]+([.,][0-9]+)?'), ',', '.'), '') AS DOUBLE) AS pct, {case(["KR", ""], "l_suppkey")} AS origin FROM l JOIN h USING (form)),
b AS (SELECT *, coalesce(last_value(nullif(sec, '') IGNORE NULLS) OVER (PARTITION BY form ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), '') AS component FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY form ORDER BY line) AS order_index FROM b WHERE ingredient <> ''), e AS (SELECT * FROM c WHERE order_index <= 60)
SELECT form, order_index, component, ingredient, CASE WHEN max(pct) OVER (PARTITION BY form) <= 1 THEN round(pct * 100, 2) ELSE pct END AS percent, origin FROM e"""

VOTERS = """SELECT p_partkey AS ref, lpad(CAST(p_partkey % 24 + 1 AS <S>), 2, '0') AS prefix, lpad(CAST(p_partkey % 24 + 1 AS <S>), 2, '0') || '0' || CAST((length(p_name) + CASE WHEN p_partkey % 40 = 0 THEN 1 ELSE 0 END) % 4 AS <S>) AS code,
  lower(p_name || ' ' || p_type) AS words, lower(p_name) AS phrase, p_size FROM {part}"""
ASKERS = """SELECT p_partkey AS product, lpad(CAST(p_partkey * 7 % 30 + 1 AS <S>), 2, '0') AS prefix, lower(p_name || CASE WHEN p_partkey % 3 = 0 THEN ' nothing' ELSE ' standard' END) AS words FROM {part}"""
D_VOTE = f"""WITH r AS (SELECT *, string_split(words, ' ') AS toks FROM ({duck(VOTERS)})), q AS (SELECT *, string_split(words, ' ') AS toks FROM ({duck(ASKERS)})), st AS (SELECT count(*) AS docs, avg(len(toks)) AS mean FROM r),
t AS (SELECT ref, prefix, len(toks) AS dl, unnest(list_distinct(toks)) AS tok FROM r), dfs AS (SELECT tok, count(*) AS df FROM t GROUP BY tok), a AS (SELECT product, prefix, unnest(list_distinct(toks)) AS tok FROM q),
s AS (SELECT product, ref, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM a JOIN dfs USING (tok) JOIN t USING (prefix, tok), st GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score DESC, ref) AS place FROM s), m AS (SELECT product, ref, place, code, phrase, list_has_all(q.toks, string_split(phrase, ' ')) AS hit FROM k JOIN r USING (ref) JOIN q USING (product) WHERE place <= 20),
g AS (SELECT product, count(*) AS n, count_if(hit) AS hits, count(DISTINCT code) FILTER (hit) AS n_codes, min(code) FILTER (hit) AS code, count(DISTINCT ref) FILTER (hit) AS n_refs, list(CAST(ref AS VARCHAR) ORDER BY place) FILTER (hit) AS refs, list_slice(list_sort(list_distinct(list(phrase) FILTER (hit))), 1, 6) AS phrases FROM m GROUP BY product),
v AS (SELECT product, g.*, CASE WHEN n IS NULL THEN 'no_lexical_overlap' WHEN hits = 0 THEN 'no_phrase_match' WHEN n_codes > 1 THEN 'distribution_split' WHEN code LIKE '%2' THEN 'not_in_tree' WHEN n_refs < 2 THEN 'k_below_min' ELSE '' END AS silence FROM q LEFT JOIN g USING (product))
SELECT product, CASE WHEN silence = '' THEN code ELSE '' END AS code, silence, coalesce(n_refs, 0) AS n_refs, coalesce(array_to_string(list_slice(refs, 1, 4), ','), '') AS refs, coalesce(array_to_string(list_slice(list_sort(list_distinct(string_split(nullif(array_to_string(phrases, ' '), ''), ' '))), 1, 8), ','), '') AS words FROM v"""


def _vote(s, d):
    def split(text):
        return rows(s, d, text).withColumn("toks", F.split("words", " "))

    rulings = split(VOTERS).withColumn("phrases", F.array("phrase"))
    return votes.precedent_vote(split(ASKERS).select("product", "prefix", "toks"), rulings, rulings.where("code NOT LIKE '%2'").select("code").distinct())


FOODS = ["cod fillet", "red pepper", "rice", "soy bean paste", "oat"]
D_PRINCIPAL = f"""WITH l AS ({duck(LINES)}), c AS (SELECT form AS product, line AS pos, {case(FOODS, "l_partkey")} AS name FROM l WHERE line <= 3), f AS (SELECT o_orderkey AS product, {case(["A cod dish", "plain", "RICE and paste", "", "an oat bar"], "o_custkey")} AS text FROM orders),
e AS (SELECT form AS product, {case(FOODS, "l_partkey")} || ' (EU)' AS name, l_suppkey % 40 + 0.5 AS percent FROM l),
i AS (SELECT product, arg_min(name, pos) AS x FROM c JOIN f USING (product) WHERE list_has_any(list_filter(regexp_extract_all(lower(name), '[a-z]+'), lambda w: length(w) >= 3), list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda w: length(w) >= 3)) GROUP BY product),
p AS (SELECT product, arg_max(name, (percent, name)) AS x FROM e WHERE percent >= 10 AND EXISTS (SELECT 1 FROM c WHERE c.product = e.product AND contains(e.name, c.name)) GROUP BY product HAVING count(*) >= 2)
SELECT product, coalesce(i.x, p.x, '') AS principal, CASE WHEN i.x IS NOT NULL THEN 'identity' WHEN p.x IS NOT NULL THEN 'percent' ELSE 'none' END AS way FROM (SELECT DISTINCT product FROM c) LEFT JOIN i USING (product) LEFT JOIN p USING (product)"""


def _principal(s, d):
    lines = rows(s, d, LINES)
    food = F.expr(case(FOODS, "l_partkey"))
    candidates = lines.where("line <= 3").select(F.col("form").alias("product"), F.col("line").alias("pos"), food.alias("name"))
    facts = rows(s, d, f"SELECT o_orderkey AS product, {case(['A cod dish', 'plain', 'RICE and paste', '', 'an oat bar'], 'o_custkey')} AS text FROM {{orders}}")
    entries = lines.select(F.col("form").alias("product"), F.concat(food, F.lit(" (EU)")).alias("name"), (F.col("l_suppkey") % 40 + 0.5).cast("double").alias("percent"))
    return votes.pick_principal(candidates, facts, entries)


NAMED = "SELECT p_partkey AS product, p_name || ' ' || p_type || CASE WHEN p_partkey % 2 = 0 THEN ' 프리미엄 다진새우살' ELSE '' END AS name FROM {part}"
FORM_KEYS = "SELECT DISTINCT p_name || CASE WHEN p_size % 3 = 0 THEN 's 새우살 프리미엄' WHEN p_size % 3 = 1 THEN ' ' || substr(p_type, 1, 4) ELSE '' END AS key FROM {part}"
SOLD = f"SELECT p_partkey AS product, {case(['[New] ', '', 'X '], 'p_partkey')} || p_name || {case([' (best) 500 g', ' 1.5kg', ' 2 ml x', ' / '], 'p_partkey')} || ' ' || lower(p_type) AS name FROM {{part}}"
STATES = ["", "Raw", "cooked", " frozen "]
GRADES = ["strong", "weak", "Medium"]
TYPED = "SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'Some ' || upper(p_name) || ' ' WHEN 1 THEN 'unknown thing' WHEN 2 THEN p_name || repeat('.', p_size) ELSE ' ' END AS value FROM {part}"
SPARSE = "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN regexp_replace(text, '[A-Za-z]+'<ALL>) WHEN 2 THEN '12 a, b.' ELSE '1 kg 밥' END AS text FROM {documents}"

QUERIES = {
    "coa_entries": (
        lambda s, d: papers.coa_entries(rows(s, d, COA_CELLS)),
        rf"""WITH c AS ({duck(COA_CELLS)}), j AS (SELECT form, line, string_agg(text, ' | ' ORDER BY pos) FILTER (text <> '') AS said, arg_min(trim(text), pos) FILTER (length(trim(text)) >= 3 AND NOT regexp_full_match(trim(text), '\d{{2,7}}-\d{{2}}-\d')) AS name FROM c GROUP BY ALL)
        SELECT form, row_number() OVER (PARTITION BY form ORDER BY line) AS order_index, coalesce(name, '') AS name, regexp_extract(said, '\b(\d{{2,7}}-\d{{2}}-\d)\b', 1) AS cas, TRY_CAST(replace(nullif(regexp_extract(said, '(\d{{1,3}}([.,]\d{{1,3}})?)\s*%', 1), ''), ',', '.') AS DOUBLE) AS percent
        FROM j WHERE regexp_matches(said, '\b\d{{2,7}}-\d{{2}}-\d\b')""",
    ),
    "inci_entries": (
        lambda s, d: papers.inci_entries(rows(s, d, INCI_CELLS)),
        rf"""WITH c AS ({duck(INCI_CELLS)}), n AS (SELECT *, length(text) - length(replace(text, ',', '')) AS n FROM c WHERE length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) > 0.7 * length(text)),
        b AS (SELECT form, text FROM n WHERE n >= 4 QUALIFY row_number() OVER (PARTITION BY form ORDER BY n DESC, line, pos) = 1), x AS (SELECT form, string_split(regexp_replace(text, '^Ingredients : ', ''), ',') AS ws FROM b), e AS (SELECT form, unnest(ws) AS name, generate_subscripts(ws, 1) AS order_index FROM x)
        SELECT form, order_index, trim(name) AS name FROM e WHERE length(trim(name)) >= 2""",
    ),
    "sheet_entries": (lambda s, d: papers.sheet_entries(rows(s, d, SHEET_CELLS)), D_SHEET),
    "read_papers": (
        lambda s, d: papers.read_papers(rows(s, d, COA_CELLS).withColumn("kind", F.lit("chemical")).unionByName(rows(s, d, INCI_CELLS).withColumn("kind", F.lit("cosmetics"))).withColumn("sheet", F.lit("A"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("form").alias("forms"), F.count("cas").alias("numbers")),
        rf"""WITH c AS ({duck(COA_CELLS)}), j AS (SELECT form, line FROM c GROUP BY ALL HAVING bool_or(regexp_matches(text, '\b\d{{2,7}}-\d{{2}}-\d\b'))), i AS ({duck(INCI_CELLS)}), n AS (SELECT *, length(text) - length(replace(text, ',', '')) AS n FROM i WHERE length(regexp_replace(text, '[^\x00-\x7F]', '', 'g')) > 0.7 * length(text)),
        b AS (SELECT form, text FROM n WHERE n >= 4 QUALIFY row_number() OVER (PARTITION BY form ORDER BY n DESC, line, pos) = 1), e AS (SELECT form, unnest(string_split(regexp_replace(text, '^Ingredients : ', ''), ',')) AS name FROM b)
        SELECT 'chemical' AS kind, count(*) AS n, count(DISTINCT form) AS forms, count(*) AS numbers FROM j HAVING count(*) > 0 UNION ALL SELECT 'cosmetics', count(*), count(DISTINCT form), 0 FROM e WHERE length(trim(name)) >= 2""",
    ),
    "labelled_cases": (
        lambda s, d: papers.labelled_cases(views.table(s, d, "pages").select(F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(" p"), F.col("page_id").cast("string"))).alias("상품명"), F.lit("other").alias("product_name"), F.when(F.col("page_id") % 7 > 0, F.col("url")).alias("url"), F.when(F.col("page_id") % 5 > 0, F.concat(F.lit("19.02 "), (F.col("page_id") % 9).cast("string"))).alias("answer"), F.lit("").alias("EU HS CODE"))),
        "SELECT max(CASE WHEN page_id % 2 = 0 THEN 'p' || CAST(page_id AS VARCHAR) ELSE 'other' END) AS name, trim(url) AS url, '1902' || CAST(page_id % 9 AS VARCHAR) AS code FROM pages WHERE page_id % 7 > 0 AND page_id % 5 > 0 AND trim(url) <> '' GROUP BY 2, 3",
    ),
    "precedent_vote": (_vote, D_VOTE),
    "pick_principal": (_principal, D_PRINCIPAL),
    "like_forms": (
        lambda s, d: votes.like_forms(rows(s, d, NAMED), rows(s, d, FORM_KEYS)),
        f"""WITH p AS (SELECT product, unnest(list_distinct(list_filter(regexp_extract_all(name, '[가-힣A-Za-z]{{2,}}'), lambda w: w <> '프리미엄'))) AS word FROM ({duck(NAMED)})), q AS (SELECT key, unnest(list_distinct(list_filter(regexp_extract_all(key, '[가-힣A-Za-z]{{2,}}'), lambda w: w <> '프리미엄'))) AS other FROM ({duck(FORM_KEYS)})),
        v AS (SELECT a.word, b.other FROM (SELECT DISTINCT word FROM p) a, (SELECT DISTINCT other FROM q) b WHERE contains(a.word, b.other) OR contains(b.other, a.word)), m AS (SELECT product, key, count(DISTINCT word) AS score FROM p JOIN v USING (word) JOIN q USING (other) GROUP BY ALL)
        SELECT product, key, score FROM m WHERE score >= 2 QUALIFY row_number() OVER (PARTITION BY product ORDER BY score DESC, key) = 1""",
    ),
    "looked_up_names": (
        lambda s, d: rows(s, d, SOLD).select("product", F.array_join(votes.looked_up_names(F.col("name")), "|").alias("names")),
        """WITH c AS (SELECT p_partkey AS product, p_name || ' ' || lower(p_type) AS n, string_split(p_name || ' ' || lower(p_type), ' ') AS ws FROM part)
        SELECT product, array_to_string(list_slice(list_concat([n], list_transform(range(2, len(ws) + 1), lambda i: array_to_string(ws[i:], ' '))), 1, 4), '|') AS names FROM c""",
    ),
    "derive_uncooked": (
        lambda s, d: votes.derive_uncooked(rows(s, d, f"SELECT p_partkey AS product, {case(STATES, 'p_partkey')} AS state, p_name || CASE WHEN p_size % 6 = 0 THEN ' Fried' ELSE '' END AS description FROM {{part}}"), rows(s, d, f"SELECT l_partkey AS product, {case(GRADES, 'l_suppkey')} AS grade, CASE WHEN l_quantity > 47 THEN 'is boiled' ELSE 'is a plant' END AS text FROM {{lineitem}}"), rows(s, d, "SELECT l_partkey AS product, lpad(CAST(l_suppkey % 24 + 1 AS <S>), 2, '0') AS chapter, l_quantity AS score FROM {lineitem}"), ["fried", "boiled"]).select("product", "derived"),
        f"""WITH a AS (SELECT l_partkey AS product, bool_or(l_quantity > 47) AS c FROM lineitem WHERE l_suppkey % 3 <> 1 GROUP BY 1), f AS (SELECT l_partkey AS product, arg_max(l_suppkey % 24 + 1, (l_quantity, l_suppkey % 24)) AS ch FROM lineitem GROUP BY 1)
        SELECT p_partkey AS product, p_partkey % {len(STATES)} <> 2 AND p_size % 6 <> 0 AND coalesce(NOT c, false) AND coalesce(ch BETWEEN 1 AND 14, false) AS derived FROM part LEFT JOIN a ON a.product = p_partkey LEFT JOIN f ON f.product = p_partkey""",
    ),
    "gate_typed": (
        lambda s, d: votes.gate_typed(rows(s, d, TYPED), votes.grounding_vocabulary([views.table(s, d, "part").select(F.col("p_name").alias("text"))])),
        f"""WITH v AS (SELECT list_distinct(list_filter(flatten(list(regexp_extract_all(lower(p_name), '[a-z]+'))), lambda w: length(w) >= 3)) AS vs FROM part), t AS (SELECT id, lower(trim(value)) AS value FROM ({duck(TYPED)}))
        SELECT id, value FROM t, v WHERE length(value) BETWEEN 1 AND 40 AND list_has_any(regexp_extract_all(value, '[a-z]+'), vs)""",
    ),
    "grounding_vocabulary": (
        lambda s, d: votes.grounding_vocabulary([views.table(s, d, "benchmark").select("text"), views.table(s, d, "part").select(F.col("p_name").alias("text")), views.table(s, d, "documents").select("text")]),
        "SELECT DISTINCT w AS word FROM (SELECT unnest(regexp_extract_all(lower(t), '[a-z]+')) AS w FROM (SELECT text AS t FROM benchmark UNION ALL SELECT p_name FROM part UNION ALL SELECT text FROM documents)) WHERE length(w) >= 3",
    ),
    "informative_texts": (
        lambda s, d: votes.informative(rows(s, d, SPARSE.replace("<ALL>", ", ''"))),
        f"SELECT * FROM ({duck(SPARSE).replace('<ALL>', ", '', 'g'")}) WHERE len(regexp_extract_all(text, '[A-Za-z가-힣]')) >= 3",
    ),
    "option_words": (
        lambda s, d: views.table(s, d, "part").select("p_partkey", votes.option_words(F.split("p_name", " "), F.split(F.lower("p_type"), " "), F.when(F.col("p_size") % 3 == 0, F.slice(F.split("p_name", " "), 1, 1)).otherwise(F.array().cast("array<string>")), F.array(F.lit("widget"))).alias("o")).select("p_partkey", F.array_join("o.positive", " ").alias("positive"), F.array_join("o.negative", " ").alias("negative")),
        """WITH w AS (SELECT p_partkey, string_split(p_name, ' ') AS ws, string_split(lower(p_type), ' ') AS ns, CASE WHEN p_size % 3 = 0 THEN [string_split(p_name, ' ')[1]] ELSE [] END AS no FROM part),
        p AS (SELECT *, list_sort(list_distinct(list_filter(ws, lambda x: NOT list_contains(no, x) AND x <> 'widget'))) AS pos FROM w)
        SELECT p_partkey, array_to_string(pos, ' ') AS positive, array_to_string(list_sort(list_distinct(list_filter(list_concat(ns, no), lambda x: NOT list_contains(pos, x)))), ' ') AS negative FROM p""",
    ),
    "accept_titles": (
        lambda s, d: votes.accept_titles(rows(s, d, f"SELECT l_orderkey AS product, line AS pos, {case(FOODS + [' '], 'l_partkey')} AS title, {case(['a food', 'a company', 'a plant'], 'l_suppkey')} AS description, {case(GRADES, 'l_partkey')} AS grade FROM (SELECT form AS l_orderkey, line, l_partkey, l_suppkey FROM ({LINES}))"), rows(s, d, f"SELECT o_orderkey AS product, {case(['cod', 'rice', 'paste'], 'o_custkey')} AS word FROM {{orders}}"), r"(?i)\bcompany\b"),
        f"""WITH l AS ({duck(LINES)}), h AS (SELECT form AS product, line AS pos, {case(FOODS + [' '], 'l_partkey')} AS title, l_suppkey % 3 <> 1 AND (l_partkey % 3 = 0 OR list_contains(string_split({case(FOODS + [' '], 'l_partkey')}, ' '), {case(['cod', 'rice', 'paste'], 'o_custkey')})) AS accepted FROM l JOIN orders ON o_orderkey = form),
        o AS (SELECT product, accepted, title, min(pos) AS pos FROM h WHERE trim(title) <> '' GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY product, accepted ORDER BY pos) AS place FROM o) SELECT product, place, title, accepted FROM k WHERE place <= CASE WHEN accepted THEN 5 ELSE 10 END""",
    ),
}
