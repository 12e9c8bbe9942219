"""Registered queries on text lines, terms and compositions, with their SQL twins."""

from __future__ import annotations

from dutyweave.operators import facts as ops
from dutyweave.plans import views
from dutyweave.sources.pages import pages_to_lines
from pyspark.sql import functions as F

D_LINES = "raw AS (SELECT doc_id AS page_id, string_split(text, chr(10)) AS ls FROM documents), lines AS (SELECT page_id, i AS pos, ls[i] AS line FROM raw, range(1, 100000) AS r(i) WHERE i <= len(ls))"
D_LABELS = "labels_ AS (SELECT DISTINCT line AS label FROM lines WHERE length(line) < 12)"


def lines(s, d):
    t = views.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", "\n")).alias("p", "line"))
    return t.select("page_id", (F.col("p") + 1).cast("long").alias("pos"), "line")


def _labels(s, d):
    return lines(s, d).where("length(line) < 12").select(F.col("line").alias("label")).distinct()


def _names(s, d):
    p = views.goods(s, d)
    return p.groupBy("label").agg(F.min("code10").alias("code10")).select(F.element_at(F.split("label", " "), 2).alias("key"), "code10").groupBy("key").agg(F.min("code10").alias("code10"))


def _sheet(s, d, flag):
    l = views.table(s, d, "lineitem").where(F.col("l_linestatus") == flag)
    return l.select((F.col("l_orderkey") % 3000).alias("product"), F.col("l_returnflag").alias("section"), F.concat(F.lit("i"), (F.col("l_partkey") % 20).cast("string")).alias("name"), F.col("l_linenumber").alias("pos"))


D_SHEET = "(SELECT l_orderkey % 3000 AS product, l_returnflag AS section, 'i' || CAST(l_partkey % 20 AS VARCHAR) AS name, l_linenumber AS pos, l_linestatus FROM lineitem)"


def _entries(s, d):
    l = views.table(s, d, "lineitem")
    return l.select(F.col("l_orderkey").alias("product"), F.concat(F.lit("i"), (F.col("l_partkey") % 20).cast("string")).alias("name"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_suppkey") % 3 == 0, F.col("l_quantity")).alias("percent"))


QUERIES = {
    "pages_to_lines": (lambda s, d: pages_to_lines(views.table(s, d, "pages")), None),
    "dedupe_runs": (
        lambda s, d: ops.dedupe_runs(lines(s, d)).select("page_id", "pos", F.md5("line").alias("line")),
        f"WITH {D_LINES}, b AS (SELECT *, lag(line) OVER (PARTITION BY page_id ORDER BY pos) AS prev FROM lines) SELECT page_id, pos, md5(line) AS line FROM b WHERE prev IS NULL OR prev <> line",
    ),
    "section_lines": (
        lambda s, d: ops.section(lines(s, d), "^The ", "^And ").select("page_id", "pos", F.md5("line").alias("line")),
        f"""WITH {D_LINES}, a AS (SELECT *, min(CASE WHEN starts_with(line, 'The ') THEN pos END) OVER (PARTITION BY page_id) AS b FROM lines),
        e AS (SELECT *, min(CASE WHEN pos >= b AND starts_with(line, 'And ') THEN pos END) OVER (PARTITION BY page_id) AS z FROM a) SELECT page_id, pos, md5(line) AS line FROM e WHERE pos > b AND (z IS NULL OR pos < z)""",
    ),
    "fields_from_lines": (
        lambda s, d: ops.fields_from_lines(lines(s, d), _labels(s, d)).select("page_id", "field_no", "label", F.md5("value").alias("value")),
        f"""WITH {D_LINES}, {D_LABELS}, g AS (SELECT page_id, pos, line, label IS NOT NULL AS is_l, sum(CASE WHEN label IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page_id ORDER BY pos) AS field_no FROM lines LEFT JOIN labels_ ON line = label)
        SELECT page_id, CAST(field_no AS BIGINT) AS field_no, arg_min(line, pos) AS label, md5(coalesce(string_agg(CASE WHEN NOT is_l THEN line END, ' ' ORDER BY pos), '')) AS value FROM g WHERE field_no > 0 GROUP BY ALL""",
    ),
    "text_spans": (
        lambda s, d: ops.text_spans(lines(s, d).select(F.col("page_id").alias("doc_id"), "line")).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("span")).alias("chars"), F.max("span").alias("last")),
        rf"""WITH {D_LINES}, x AS (SELECT page_id AS doc_id, trim(line, ' ') AS t, line FROM lines),
        sp AS (SELECT doc_id, t AS span FROM x UNION SELECT doc_id, trim(unnest(string_split_regex(line, '[,;/()]+')), ' ') FROM x UNION SELECT doc_id, unnest(string_split_regex(t, '\s+')) FROM x)
        SELECT doc_id, count(*) AS n, CAST(sum(length(span)) AS BIGINT) AS chars, max(span) AS last FROM sp WHERE span <> '' GROUP BY doc_id""",
    ),
    "bigram_lookup": (
        lambda s, d: ops.bigram_lookup(views.table(s, d, "supplier").select(F.lower(F.concat(F.lit("hot "), F.substring("s_name", 1, 6))).alias("query")).union(views.table(s, d, "part").select(F.concat("p_name", F.lit(" gear")).alias("query"))).distinct(), views.table(s, d, "part").select(F.col("p_name").alias("term")).distinct()),
        """WITH q AS (SELECT DISTINCT query FROM (SELECT lower('hot ' || substr(s_name, 1, 6)) AS query FROM supplier UNION ALL SELECT p_name || ' gear' FROM part)), d AS (SELECT DISTINCT p_name AS term FROM part),
        qb AS (SELECT DISTINCT query, substr(t, i, 2) AS b FROM (SELECT query, replace(lower(query), ' ', '') AS t FROM q), range(1, 60) AS r(i) WHERE i < length(t)), db AS (SELECT DISTINCT term, substr(t, i, 2) AS b FROM (SELECT term, replace(lower(term), ' ', '') AS t FROM d), range(1, 60) AS r(i) WHERE i < length(t)),
        s AS (SELECT query, term, count(*) AS shared FROM qb JOIN db USING (b) GROUP BY ALL), j AS (SELECT query, term, shared, round(shared / (nq + nd - shared), 6) AS jaccard FROM s JOIN (SELECT query, count(*) AS nq FROM qb GROUP BY query) USING (query) JOIN (SELECT term, count(*) AS nd FROM db GROUP BY term) USING (term)),
        k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY shared DESC, jaccard DESC, term) AS place FROM j) SELECT * FROM k WHERE place <= 3""",
    ),
    "bridge_terms": (
        lambda s, d: ops.bridge_terms(views.table(s, d, "part").select(F.col("p_partkey").alias("entry_id"), F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("x"), F.regexp_replace("p_name", " ", ""))).otherwise(F.col("p_name")).alias("name")), _names(s, d)),
        f"""{views.WITH_GOODS}, k AS (SELECT string_split(label, ' ')[2] AS key, min(code10) AS code10 FROM goods GROUP BY 1), n AS (SELECT p_partkey AS entry_id, lower(CASE WHEN p_partkey % 3 = 0 THEN 'x' || replace(p_name, ' ', '') ELSE p_name END) AS name FROM part),
        h AS (SELECT entry_id, key, code10, CASE WHEN name = key THEN 1 WHEN list_contains(string_split_regex(name, '\\s+'), key) THEN 2 ELSE 3 END AS tier FROM n JOIN k ON contains(name, key) AND (length(key) >= 2 OR name = key OR list_contains(string_split_regex(name, '\\s+'), key))),
        b AS (SELECT *, row_number() OVER (PARTITION BY entry_id ORDER BY tier, length(key) DESC, key, code10) AS r FROM h) SELECT entry_id, key, code10, coalesce(tier, 0) AS tier FROM n LEFT JOIN (SELECT * FROM b WHERE r = 1) USING (entry_id)""",
    ),
    "merge_compositions": (
        lambda s, d: ops.merge_compositions(_sheet(s, d, "O"), _sheet(s, d, "F")),
        f"""WITH a AS (SELECT product, section, name, min(pos) AS pos, 'sheet' AS origin FROM {D_SHEET} WHERE l_linestatus = 'O' GROUP BY ALL)
        SELECT * FROM a UNION ALL SELECT product, section, name, pos, 'label' FROM {D_SHEET} t WHERE l_linestatus = 'F' AND NOT EXISTS (SELECT 1 FROM a WHERE a.product = t.product AND a.name = t.name)""",
    ),
    "detect_domain": (
        lambda s, d: ops.detect_domain(lines(s, d), s.createDataFrame([("the", "a"), ("that", "a"), ("and", "b"), ("of", "b")], "word string, domain string")),
        f"""WITH w AS (SELECT doc_id AS page_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents), c AS (SELECT page_id, count_if(w IN ('the', 'that')) AS n_a, count_if(w IN ('and', 'of')) AS n_b FROM w GROUP BY page_id)
        SELECT page_id, CASE WHEN n_a = 0 AND n_b = 0 THEN 'unknown' WHEN n_a = n_b THEN 'ambiguous' WHEN n_a > n_b THEN 'a' ELSE 'b' END AS domain, n_a, n_b FROM c""",
    ),
    "scoped_vocabulary": (
        lambda s, d: ops.scoped_vocabulary(views.table(s, d, "documents").select(F.col("source").alias("owner"), F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("word <> ''")),
        "WITH w AS (SELECT source, unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM documents) SELECT word, count(DISTINCT source) AS n_owners FROM w WHERE word <> '' GROUP BY word HAVING count(DISTINCT source) <= 3",
    ),
    "gate_text": (
        lambda s, d: ops.gate_text(views.table(s, d, "documents"), views.table(s, d, "benchmark").select(F.explode(F.split(F.lower("text"), r"[^a-z]+")).alias("word")).where("word <> ''").distinct()),
        """WITH v AS (SELECT DISTINCT word FROM (SELECT unnest(string_split_regex(lower(text), '[^a-z]+')) AS word FROM benchmark) WHERE word <> ''), a AS (SELECT word FROM v UNION SELECT word || 's' FROM v),
        t AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS ws FROM documents), w AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM t),
        f AS (SELECT doc_id, word, min(pos) AS pos FROM w WHERE word <> '' AND word IN (SELECT word FROM a) GROUP BY ALL), k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS r FROM f)
        SELECT doc_id, coalesce(x, '') AS kept FROM documents LEFT JOIN (SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS x FROM k WHERE r <= 10 GROUP BY doc_id) USING (doc_id)""",
    ),
    "harvest_phrases": (
        lambda s, d: ops.harvest_phrases(views.table(s, d, "benchmark").select((F.col("item_id") % 7).alias("owner"), F.col("item_id").alias("pos"), "text")),
        r"""WITH x AS (SELECT item_id % 7 AS owner, item_id AS pos, string_split_regex(text, '[.;\n]') AS ps FROM benchmark), p AS (SELECT owner, pos, generate_subscripts(ps, 1) AS part, lower(trim(unnest(ps), ' ')) AS phrase FROM x),
        f AS (SELECT owner, phrase, min((pos, part)) AS pt FROM p WHERE length(phrase) >= 4 GROUP BY ALL) SELECT owner, phrase, row_number() OVER (PARTITION BY owner ORDER BY pt, phrase) AS place FROM f""",
    ),
    "principal_candidates": (
        lambda s, d: ops.principal_candidates(_entries(s, d)),
        """WITH e AS (SELECT l_orderkey AS product, 'i' || CAST(l_partkey % 20 AS VARCHAR) AS name, l_linenumber AS pos, CASE WHEN l_suppkey % 3 = 0 THEN l_quantity END AS percent FROM lineitem),
        c AS (SELECT product, name, 0.65 AS c, 'first_listed' AS b FROM e WHERE pos = 1 UNION ALL SELECT product, name, CASE WHEN percent >= 15 THEN 0.9 ELSE 0.35 END, 'percent' FROM e WHERE percent IS NOT NULL)
        SELECT product, name, max(c)::DOUBLE AS confidence, string_agg(DISTINCT b, ';' ORDER BY b) AS bases, max(c) >= 0.8 AS confirmed FROM c GROUP BY ALL""",
    ),
    "scale_percent": (
        lambda s, d: ops.scale_percent(views.table(s, d, "lineitem").select((F.col("l_orderkey") % 997).alias("file"), F.col("l_linenumber").alias("row"), F.when(F.col("l_orderkey") % 2 == 0, F.col("l_discount")).otherwise(F.col("l_quantity")).alias("percent"))),
        """WITH e AS (SELECT l_orderkey % 997 AS file, l_linenumber AS row, CASE WHEN l_orderkey % 2 = 0 THEN l_discount ELSE l_quantity END AS percent FROM lineitem)
        SELECT file, row, CASE WHEN max(percent) OVER (PARTITION BY file) <= 1 THEN percent * 100 ELSE percent END AS percent FROM e""",
    ),
    "latest_revision": (
        lambda s, d: ops.latest_revision(views.table(s, d, "orders").select((F.col("o_custkey")).alias("lineage"), F.date_format("o_orderdate", "yyyyMMdd").alias("stamp"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"))),
        """WITH f AS (SELECT o_custkey AS lineage, strftime(o_orderdate, '%Y%m%d') AS stamp, 'f' || CAST(o_orderkey AS VARCHAR) AS name FROM orders),
        r AS (SELECT *, row_number() OVER (PARTITION BY lineage ORDER BY stamp DESC, name DESC) AS r FROM f) SELECT lineage, stamp, name FROM r WHERE r = 1""",
    ),
    "drop_subsumed": (
        lambda s, d: ops.drop_subsumed(_sheet(s, d, "O").select("product", F.concat("section", (F.col("pos") % 3).cast("string")).alias("form"), F.concat(F.lit("i"), (F.substring("name", 2, 5).cast("int") % 3).cast("string")).alias("name"))),
        f"""WITH n AS (SELECT DISTINCT product, section || CAST(pos % 3 AS VARCHAR) AS form, 'i' || CAST(CAST(substr(name, 2) AS INT) % 3 AS VARCHAR) AS name FROM {D_SHEET} WHERE l_linestatus = 'O'), z AS (SELECT product, form, list_sort(list(name)) AS s FROM n GROUP BY ALL)
        SELECT product, form, len(s) AS n FROM z a WHERE NOT EXISTS (SELECT 1 FROM z b WHERE a.product = b.product AND a.form <> b.form AND list_has_all(b.s, a.s) AND (len(b.s) > len(a.s) OR b.form < a.form))""",
    ),
}
