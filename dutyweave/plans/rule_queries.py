"""Registered queries on compiled rules and further joins, with their SQL twins."""

from __future__ import annotations

from dutyweave.operators import classify, ingest, requirements, rules
from dutyweave.plans import views
from dutyweave.plans.classify_queries import D_RANKED, VERDICTS, ranked, rulings, verdicts
from dutyweave.plans.requirement_queries import GROUPS, _groups
from pyspark.sql import functions as F

D_WORDS = "ws AS (SELECT DISTINCT p_type AS parent, p_brand AS code, unnest(string_split(p_name, ' ')) AS word FROM part)"
CONDS = ("processing_state", "preservation_state", "identity", "species")


def _words(s, d):
    p = views.table(s, d, "part")
    return p.select(F.col("p_type").alias("parent"), F.col("p_brand").alias("code"), F.explode(F.split("p_name", " ")).alias("word")).distinct()


D_PART_WORDS = "ws AS (SELECT DISTINCT p_type AS parent, CAST(p_partkey AS VARCHAR) AS code, unnest(string_split(p_name, ' ')) AS word FROM part)"


def _part_words(s, d):
    p = views.table(s, d, "part")
    return p.select(F.col("p_type").alias("parent"), F.col("p_partkey").cast("string").alias("code"), F.explode(F.split("p_name", " ")).alias("word")).distinct()


def _labels(s, d):
    p = views.table(s, d, "part")
    return p.select(F.col("p_type").alias("parent"), F.col("p_partkey").alias("code"), F.concat(F.when(F.col("p_partkey") % 3 == 0, F.concat("p_brand", F.lit(" ; "), "p_type", F.lit(" ; "))).otherwise(""), F.when(F.col("p_partkey") % 5 == 0, "Other").otherwise(F.col("p_name")), F.when(F.col("p_partkey") % 2 == 0, ", whether or not cooked").otherwise("")).alias("label"))


def _certs(s, d):
    return _groups(s, d).select(F.col("legal_base").alias("product"), "certificate").distinct()


def _mapping(s):
    return s.createDataFrame([("g1", "C-0001"), ("g2", "C-00"), ("g1", "C-"), ("g3", "Y-0002"), ("g4", "Q")], "guideline string, prefix string")


def _gate(s, d):
    v = verdicts(s, d)
    return v.select("product", "code", "verdict", F.element_at(F.array(*[F.lit(c) for c in CONDS]), (F.col("l_linenumber") % 4 + 1).cast("int")).alias("cond"), F.when(F.col("kind") == "pool", "alias").when(F.col("kind") == "partial", "precedent").otherwise("field").alias("source"))


def _rolled(s, d):
    return classify.roll_up(verdicts(s, d), ["product", "code"])


D_ROLLED = f"""v AS ({views.for_duckdb(VERDICTS)}), o AS (SELECT product, code, CASE WHEN alt_group = '' THEN 'row:' || row_id ELSE alt_group END AS g, count_if(verdict) AS t, count_if(NOT verdict) AS f, count(*) AS n FROM v GROUP BY ALL),
u AS (SELECT product, code, CASE WHEN t > 0 THEN 1 WHEN f = n THEN -1 ELSE 0 END AS x FROM o), rolled AS (SELECT product, code, CASE WHEN min(x) = -1 THEN 'violated' WHEN min(x) = 1 THEN 'confirmed' ELSE 'undecided' END AS decision FROM u GROUP BY ALL)"""


def _runs(s, d):
    e = views.table(s, d, "events")
    details = F.array(F.struct(F.col("event_type").alias("axis"), F.when(F.col("user_id") % 2 == 0, "true").otherwise("false").alias("verdict")), F.struct(F.lit("form").alias("axis"), F.lit("unknown").alias("verdict")))
    cands = F.array(F.struct(F.concat(F.lit("c"), (F.col("user_id") % 9).cast("string")).alias("code"), details.alias("details")))
    stages = F.array(F.struct(F.lit(4).alias("level"), cands.alias("candidates")), F.struct(F.lit(6).alias("level"), cands.alias("candidates")))
    return e.select(F.col("event_id").alias("run"), F.to_json(F.struct(stages.alias("stages"))).alias("payload"))


def _package(s, d):
    o = views.table(s, d, "orders")
    return o.select(F.col("o_custkey").alias("package"), F.col("o_orderkey").alias("pos"), "o_orderpriority", F.regexp_replace("o_orderpriority", "^[0-9]-", "Doc ").alias("name"), F.when(F.col("o_orderstatus") == "F", "exempted").otherwise("required").alias("status"))


QUERIES = {
    "split_labels": (
        lambda s, d: rules.split_labels(_labels(s, d)),
        r"""WITH l AS (SELECT p_type AS parent, p_partkey AS code, CASE WHEN p_partkey % 5 = 0 THEN 'Other' ELSE p_name END AS leaf, CASE WHEN p_partkey % 3 = 0 THEN p_brand || ' ; ' || p_type ELSE '' END AS above, p_partkey % 2 = 0 AS c FROM part)
        SELECT parent, code, CASE WHEN c THEN leaf || ',' ELSE leaf END AS leaf, above, leaf = 'Other' AS residual FROM l""",
    ),
    "rare_words": (
        lambda s, d: rules.rare_words(_part_words(s, d)),
        f"WITH {D_PART_WORDS} SELECT parent, code, word, df, n FROM ws JOIN (SELECT parent, word, count(*) AS df FROM ws GROUP BY ALL) USING (parent, word) JOIN (SELECT parent, count(DISTINCT code) AS n FROM ws GROUP BY parent) USING (parent) WHERE df * 2 <= n",
    ),
    "clean_values": (
        lambda s, d: rules.clean_values(_words(s, d).select("parent", "code", F.col("word").alias("value"))),
        f"""WITH {D_WORDS}, j AS (SELECT parent, code, word, ow >= greatest(2, n / 2) AS dr FROM ws JOIN (SELECT parent, word, count(*) AS ow FROM ws GROUP BY ALL) USING (parent, word) JOIN (SELECT parent, count(DISTINCT code) AS n FROM ws GROUP BY parent) USING (parent)),
        k AS (SELECT *, count_if(NOT dr) OVER (PARTITION BY parent, code) AS kept, row_number() OVER (PARTITION BY parent, code ORDER BY length(word) DESC, word) AS r FROM j) SELECT parent, code, word AS value, kept = 0 AS fallback FROM k WHERE NOT dr OR (kept = 0 AND r = 1)""",
    ),
    "mirror_exclusions": (
        lambda s, d: rules.mirror_exclusions(_words(s, d).select("parent", "code", F.col("word").alias("value")), _words(s, d).where("code < 'Brand#12'").select("parent", "code").distinct()),
        f"""WITH {D_WORDS}, f AS (SELECT w.parent, r.code AS residual, word AS value, min(w.code) AS code FROM ws w JOIN (SELECT DISTINCT parent, code FROM ws WHERE code < 'Brand#12') r ON w.parent = r.parent AND w.code <> r.code GROUP BY ALL),
        k AS (SELECT parent, residual, value, row_number() OVER (PARTITION BY parent, residual ORDER BY code, value) AS place FROM f) SELECT * FROM k WHERE place <= 8""",
    ),
    "mine_aliases": (
        lambda s, d: rules.mine_aliases(_words(s, d).select(F.col("word"), F.col("parent").alias("lineage"), F.left("code", F.lit(7)).alias("cls"))),
        f"""WITH {D_WORDS}, l AS (SELECT DISTINCT word, parent AS lineage, substr(code, 1, 7) AS cls FROM ws), h AS (SELECT word, cls, n FROM (SELECT word, cls, count(DISTINCT lineage) AS k FROM l GROUP BY ALL) JOIN (SELECT word, count(DISTINCT lineage) AS n FROM l GROUP BY word) USING (word) WHERE k = n),
        k AS (SELECT *, row_number() OVER (PARTITION BY word ORDER BY cls) AS place FROM h) SELECT * FROM k WHERE place <= 6""",
    ),
    "coverage": (
        lambda s, d: rules.coverage(views.table(s, d, "lineitem").select(F.col("l_linenumber").alias("level"), F.col("l_returnflag").alias("axis"), (F.col("l_tax") > 0.04).alias("tagged"))),
        "SELECT l_linenumber AS level, l_returnflag AS axis, count(*) AS n, count_if(l_tax > 0.04) AS n_tagged, round(100 * count_if(l_tax > 0.04) / count(*), 4) AS percent FROM lineitem GROUP BY ROLLUP (l_linenumber, l_returnflag)",
    ),
    "chapter_words": (
        lambda s, d: rules.chapter_words(views.table(s, d, "benchmark").select(F.col("item_id").alias("chapter"), F.col("text").alias("title")), ["the", "of", "and"]),
        """WITH w AS (SELECT item_id AS chapter, list_slice(regexp_extract_all(lower(text), '[a-z]+'), 1, 24) AS ws FROM benchmark), e AS (SELECT chapter, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM w), f AS (SELECT chapter, w, min(i) AS i FROM e WHERE w NOT IN ('the', 'of', 'and') GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY chapter ORDER BY i) AS r FROM f) SELECT chapter, coalesce(string_agg(w, ' ' ORDER BY i) FILTER (r <= 10), '') AS words FROM k GROUP BY chapter""",
    ),
    "attach_acts": (
        lambda s, d: requirements.attach_acts(views.measures(s, d).select("measure_id", "legal_base"), views.table(s, d, "supplier").where("s_suppkey % 3 > 0").select(F.concat(F.lit("R"), F.lpad(F.col("s_suppkey").cast("string"), 4, "0")).alias("legal_base"), F.col("s_nationkey").alias("act_id")), views.table(s, d, "nation").select((F.col("n_nationkey") % 20).alias("act_id"), F.col("n_nationkey").alias("chunk"), F.col("n_name").alias("text")), 12),
        f"""{views.WITH_MEASURES}, t AS (SELECT n_nationkey % 20 AS act_id, string_agg(n_name, ' ' ORDER BY n_nationkey) AS x FROM nation GROUP BY 1), a AS (SELECT 'R' || lpad(CAST(s_suppkey AS VARCHAR), 4, '0') AS legal_base, s_nationkey AS act_id FROM supplier WHERE s_suppkey % 3 > 0)
        SELECT measure_id, legal_base, act_id, substr(coalesce(x, ''), 1, 12) AS act_text FROM measures LEFT JOIN a USING (legal_base) LEFT JOIN t USING (act_id)""",
    ),
    "scope_join_domain": (
        lambda s, d: requirements.scope_join_domain(views.table(s, d, "part").select(F.col("p_partkey").alias("product"), F.concat_ws(";", F.lower("p_type"), F.when(F.col("p_size") > 30, "big")).alias("domains")), s.createDataFrame([("d1", "economy;big"), ("d2", "all"), ("d3", "small"), ("d4", "none")], "document string, domains string")),
        """SELECT p_partkey AS product, document FROM part, (VALUES ('d1'), ('d2'), ('d3')) AS t(document) WHERE document = 'd2' OR (document = 'd1' AND (p_type = 'ECONOMY' OR p_size > 30)) OR (document = 'd3' AND p_type = 'SMALL')""",
    ),
    "match_guidelines": (
        lambda s, d: requirements.match_guidelines(_certs(s, d), _mapping(s), _certs(s, d).where("certificate = 'Y-0001'").select("product", F.lit("g2").alias("guideline")).distinct()),
        f"""{views.WITH_MEASURES}, {GROUPS}, c AS (SELECT DISTINCT legal_base AS product, certificate FROM grp), m(guideline, prefix) AS (VALUES ('g1', 'C-0001'), ('g2', 'C-00'), ('g1', 'C-'), ('g3', 'Y-0002'), ('g4', 'Q')),
        k AS (SELECT product, guideline, certificate, prefix, row_number() OVER (PARTITION BY product, guideline ORDER BY certificate = prefix DESC, certificate, prefix) AS r FROM c JOIN m ON starts_with(certificate, prefix) WHERE NOT (guideline = 'g2' AND product IN (SELECT product FROM c WHERE certificate = 'Y-0001')))
        SELECT product, guideline, certificate, prefix FROM k WHERE r = 1""",
    ),
    "bind_documents": (
        lambda s, d: requirements.bind_documents(views.table(s, d, "orders").select(F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("detail")), views.table(s, d, "orders").select(F.col("o_orderpriority").alias("detail"), F.concat(F.lit("doc"), (F.col("o_orderkey") % 4).cast("string")).alias("document"), F.when(F.col("o_orderkey") % 8 == 0, "mandatory").when(F.col("o_orderkey") % 8 < 4, "conditional").otherwise("optional").alias("level"), F.col("o_orderstatus").alias("field")).distinct()),
        """WITH b AS (SELECT DISTINCT o_orderpriority AS detail, 'doc' || CAST(o_orderkey % 4 AS VARCHAR) AS document, CASE WHEN o_orderkey % 8 = 0 THEN 'mandatory' WHEN o_orderkey % 8 < 4 THEN 'conditional' ELSE 'optional' END AS level, o_orderstatus AS field FROM orders)
        SELECT o_custkey AS subject, document, arg_min(level, CASE level WHEN 'mandatory' THEN 0 WHEN 'conditional' THEN 1 ELSE 2 END) AS level, string_agg(DISTINCT field, ';' ORDER BY field) AS fields, count(*) AS n FROM orders JOIN b ON o_orderpriority = detail GROUP BY ALL""",
    ),
    "required_documents": (
        lambda s, d: requirements.required_documents(_groups(s, d)),
        f"{views.WITH_MEASURES}, {GROUPS} SELECT certificate, min(measure_type_code) AS first_kind, count(DISTINCT legal_base) AS bases FROM grp WHERE substr(certificate, 1, 1) NOT IN ('Y', 'u') GROUP BY certificate",
    ),
    "signals": (
        lambda s, d: requirements.signals(views.goods(s, d).join(views.measures(s, d).groupBy(F.col("goods_code_10").alias("code10")).agg(F.count(F.lit(1)).alias("n")), "code10", "left").select(F.col("p_partkey").alias("product"), F.coalesce("n", F.lit(0)).alias("n_measures"), F.col("label").startswith("red").alias("ambiguous"))),
        f"""{views.WITH_MEASURES} SELECT p_partkey AS product, 'no_measures' AS signal FROM goods WHERE code10 NOT IN (SELECT goods_code_10 FROM measures) UNION ALL SELECT p_partkey, 'ambiguous_domain' FROM goods WHERE starts_with(label, 'red')""",
    ),
    "document_families": (
        lambda s, d: views.table(s, d, "part").select("p_partkey", requirements.document_family(F.concat("p_name", F.when(F.col("p_partkey") % 4 == 0, " Phytosanitary paper").when(F.col("p_partkey") % 4 == 1, " CPNP health note").otherwise(""))).alias("family")),
        "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'health' WHEN 1 THEN 'cosmetics' ELSE 'other' END AS family FROM part",
    ),
    "gate_confirmed": (
        lambda s, d: classify.gate_confirmed(_rolled(s, d), _gate(s, d), ["alias", "precedent"]),
        f"""WITH {D_ROLLED}, t AS (SELECT product, code, bool_and(l_linenumber % 4 < 2) AS states, bool_or(kind NOT IN ('pool', 'partial')) AS typed FROM v WHERE verdict GROUP BY ALL)
        SELECT product, code, CASE WHEN decision = 'confirmed' AND (coalesce(states, false) OR NOT coalesce(typed, false)) THEN 'undecided' ELSE decision END AS decision FROM rolled LEFT JOIN t USING (product, code)""",
    ),
    "final_candidates": (
        lambda s, d: classify.final_candidates(ranked(s, d).select("product", "code", (20 - F.col("score")).alias("rank")), views.goods(s, d).groupBy(F.left("code10", F.lit(4)).alias("code")).agg(F.min("label").alias("label")), 2),
        f"""{D_RANKED}, c AS (SELECT substr(code10, 1, 4) AS code, min(label) AS label FROM goods GROUP BY 1), k AS (SELECT product, code, 20 - score AS rank, label, row_number() OVER (PARTITION BY product ORDER BY 20 - score, code) AS place FROM ranked JOIN c USING (code)) SELECT * FROM k WHERE place <= 2""",
    ),
    "ruling_pool": (
        lambda s, d: classify.ruling_pool(views.goods(s, d).select(F.col("p_partkey").alias("product"), "code10"), [rulings(s, d).where("ref % 2 = 0").select("ref", "code10"), rulings(s, d).select("ref", "code10", "prefix")]),
        f"""{views.WITH_GOODS}, r AS (SELECT doc_id AS ref, code10 FROM documents JOIN goods ON p_partkey = doc_id % 2000 WHERE len(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 3)) > 0), p AS (SELECT ref, code10, 0 AS source FROM r WHERE ref % 2 = 0 UNION ALL SELECT ref, code10, 1 FROM r),
        j AS (SELECT p_partkey AS product, ref, source, tier FROM goods g JOIN p ON true, (VALUES (0, 8), (1, 6), (2, 4)) AS t(tier, w) WHERE substr(g.code10, 1, w) = substr(p.code10, 1, w)),
        k AS (SELECT *, row_number() OVER (PARTITION BY product, ref ORDER BY source, tier) AS r FROM j) SELECT product, ref, source, tier FROM k WHERE r = 1""",
    ),
    "state_conflict": (
        lambda s, d: classify.state_conflict(ranked(s, d).select("product", F.concat(F.lit("w"), (F.col("product") % 5).cast("string")).alias("word")).distinct(), ranked(s, d).where("score % 2 = 0").select("parent", "code", F.concat(F.lit("w"), (F.col("score") % 5).cast("string")).alias("word")).distinct(), ranked(s, d).select("product", "parent", "code", "decision")),
        f"""{D_RANKED}, q AS (SELECT DISTINCT parent, code, score % 5 AS w FROM ranked WHERE score % 2 = 0), j AS (SELECT product, parent, code, decision, EXISTS (SELECT 1 FROM q WHERE q.parent = r.parent AND q.w = r.product % 5) AND NOT EXISTS (SELECT 1 FROM q WHERE q.parent = r.parent AND q.code = r.code AND q.w = r.product % 5) AS conflict FROM ranked r)
        SELECT product, parent, code, CASE WHEN conflict AND decision = 'confirmed' THEN 'undecided' ELSE decision END AS decision, conflict FROM j""",
    ),
    "load_forms": (
        lambda s, d: ingest.load_forms(views.table(s, d, "supplier").where("s_suppkey % 2 = 0").select(F.concat(F.lit("f"), F.col("s_suppkey").cast("string")).alias("form")), views.table(s, d, "part").select(F.col("p_partkey").alias("product"), F.concat(F.lit("f"), (F.col("p_partkey") % 100).cast("string"), F.lit("; f"), (F.col("p_size") % 100).cast("string"), F.lit(";")).alias("forms")))[1],
        "SELECT DISTINCT p_partkey AS product, form FROM part, (SELECT 'f' || CAST(s_suppkey AS VARCHAR) AS form FROM supplier WHERE s_suppkey % 2 = 0) WHERE form IN ('f' || CAST(p_partkey % 100 AS VARCHAR), 'f' || CAST(p_size % 100 AS VARCHAR))",
    ),
    "route_documents": (
        lambda s, d: ingest.route_documents(views.table(s, d, "part").select("p_partkey", F.concat("p_name", F.when(F.col("p_partkey") % 3 == 0, " COA.xlsx").when(F.col("p_partkey") % 3 == 1, " msds.pdf").otherwise(".xlsx")).alias("name"))),
        "SELECT p_partkey, p_name || CASE p_partkey % 3 WHEN 0 THEN ' COA.xlsx' WHEN 1 THEN ' msds.pdf' ELSE '.xlsx' END AS name, CASE p_partkey % 3 WHEN 0 THEN 'certificate' WHEN 1 THEN 'safety' ELSE 'food' END AS kind, CASE p_partkey % 3 WHEN 1 THEN 'stub' ELSE 'parsed' END AS status FROM part",
    ),
    "explode_runs": (
        lambda s, d: ingest.explode_runs(_runs(s, d)),
        """SELECT event_id AS run, level, 'c' || CAST(user_id % 9 AS VARCHAR) AS code, CASE k WHEN 0 THEN event_type ELSE 'form' END AS axis, CASE WHEN k = 1 THEN 'unknown' WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS verdict FROM events, (VALUES (4), (6)) AS l(level), (VALUES (0), (1)) AS n(k)""",
    ),
    "package_documents": (
        lambda s, d: ingest.flatten_package_documents(_package(s, d), _package(s, d).groupBy("package").agg(F.min("o_orderpriority").alias("name"))),
        r"""WITH p AS (SELECT o_custkey AS package, o_orderkey AS pos, o_orderpriority AS pr, regexp_replace(o_orderpriority, '^[0-9]-', 'Doc ') AS name, o_orderstatus FROM orders),
        k AS (SELECT package, name, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') AS key, row_number() OVER (PARTITION BY package, regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g') ORDER BY pos) AS r FROM p WHERE o_orderstatus <> 'F')
        SELECT package, CASE WHEN r > 1 THEN key || '_' || CAST(r AS VARCHAR) ELSE key END AS key, name FROM k UNION ALL SELECT package, regexp_replace(lower(min(pr)), '[^a-z0-9]+', '-', 'g'), min(pr) FROM p WHERE package NOT IN (SELECT package FROM k) GROUP BY package""",
    ),
}
