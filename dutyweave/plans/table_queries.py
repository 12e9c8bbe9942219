"""Registered queries on reference tables, evaluation, events and vectors, with their SQL twins."""

from __future__ import annotations

from dutyweave.operators import evaluate, hooks, ingest
from dutyweave.plans import views
from dutyweave.streaming import runs
from pyspark.sql import functions as F


def _history(s, d):
    o = views.table(s, d, "orders")
    h = o.groupBy(F.concat(F.lit("a"), (F.col("o_custkey") % 50).cast("string")).alias("asset"), F.year("o_orderdate").alias("version")).agg(F.max("o_totalprice").cast("string").alias("payload"), F.max("o_orderdate").alias("updated_at"))
    return h.select("asset", "version", "payload", "updated_at", F.sha2("payload", 256).alias("source_hash"), (F.col("version") % 2 == 0).alias("is_active"))


def _incoming(s, d):
    o = views.table(s, d, "orders").where("o_custkey % 50 < 20 AND year(o_orderdate) = 2000")
    return o.groupBy(F.concat(F.lit("a"), (F.col("o_custkey") % 50).cast("string")).alias("asset")).agg(F.lit(2000).alias("version"), F.min("o_orderpriority").alias("payload"), F.lit("2030-01-01 00:00:00").cast("timestamp").alias("updated_at"))


D_HISTORY = """h AS (SELECT 'a' || CAST(o_custkey % 50 AS VARCHAR) AS asset, year(o_orderdate) AS version, max(o_totalprice) AS p, max(o_orderdate) AS updated_at, year(o_orderdate) % 2 = 0 AS is_active FROM orders GROUP BY ALL)"""


def _terms(s, d):
    e = views.table(s, d, "events")
    return e.select("event_id", "ts", (F.col("user_id") % 40).alias("term"), F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("raw"))


def _stream(s, d):
    path = f"{d}/events.parquet"
    return runs.event_stream(s, path, s.read.parquet(path).schema)


def _signed(e):
    return e.select((F.col("user_id") % 60).alias("signature"), "event_id", F.when(F.col("event_type") == "purchase", "closed").otherwise("request").alias("status"))


BOXES = """SELECT l_orderkey AS page, l_orderkey * 10 + l_linenumber AS box_id, min(l_suppkey) % 3 * 10 AS x1, min(l_partkey) % 3 * 5 AS y1, min(l_suppkey) % 3 * 10 + 20 + l_linenumber AS x2, min(l_partkey) % 3 * 5 + 20 AS y2,
  CASE WHEN l_linenumber % 4 = 0 THEN '' ELSE min(l_returnflag) || CASE WHEN min(l_partkey) % 2 = 0 THEN '  ' ELSE ' ' END || CAST(min(l_partkey) % 9 AS <S>) END AS text FROM {lineitem} GROUP BY l_orderkey, l_linenumber"""


def _boxes(s, d):
    return s.sql(BOXES.replace("<S>", "STRING"), lineitem=views.table(s, d, "lineitem"))


def _preds(s, d):
    g = views.goods(s, d)
    p = g.select(F.col("p_partkey").alias("case_id"), F.explode(F.sequence(F.lit(1), F.lit(6))).alias("rank"), "code10")
    code = F.when((F.col("case_id") + F.col("rank")) % 4 == 0, F.col("code10")).when((F.col("case_id") + F.col("rank")) % 3 == 0, F.concat(F.left("code10", F.lit(6)), F.lit("9999"))).otherwise(F.concat(F.left("code10", F.lit(2)), F.lit("99999999")))
    return p.select("case_id", "rank", code.alias("code10"))


D_PREDS = "p AS (SELECT p_partkey AS case_id, rank, code10 AS truth, CASE WHEN (p_partkey + rank) % 4 = 0 THEN code10 WHEN (p_partkey + rank) % 3 = 0 THEN substr(code10, 1, 6) || '9999' ELSE substr(code10, 1, 2) || '99999999' END AS code10 FROM goods, range(1, 7) AS r(rank))"


def _cells(s, d, flag):
    l = views.table(s, d, "lineitem").where(F.col("l_linestatus") == flag)
    return l.select((F.col("l_orderkey") % 500).alias("table_id"), F.concat("l_returnflag", (F.col("l_linenumber")).cast("string")).alias("cell"))


def _observations(s, d):
    l = views.table(s, d, "lineitem")
    return l.select((F.col("l_orderkey") % 4000).alias("subject"), F.col("l_linenumber").alias("run"), F.concat(F.lit("x"), (F.col("l_suppkey") % 4).cast("string")).alias("axis"), F.concat(F.lit("f"), (F.col("l_partkey") % 5).cast("string")).alias("field"), F.when(F.col("l_returnflag") == "A", "true").when(F.col("l_returnflag") == "R", "false").otherwise("unknown").alias("verdict"), (F.col("l_partkey") % 3 == 0).alias("supports"))


D_OBS = """o AS (SELECT l_orderkey % 4000 AS subject, l_linenumber AS run, 'x' || CAST(l_suppkey % 4 AS VARCHAR) AS axis, 'f' || CAST(l_partkey % 5 AS VARCHAR) AS field, CASE l_returnflag WHEN 'A' THEN 'true' WHEN 'R' THEN 'false' ELSE 'unknown' END AS verdict, l_partkey % 3 = 0 AS supports FROM lineitem),
m AS (SELECT axis, field, verdict, supports, count(*) AS n FROM o WHERE run = (SELECT max(run) FROM o b WHERE b.subject = o.subject) GROUP BY ALL)"""


def _amounts(s, d, flag):
    l = views.table(s, d, "lineitem").where(F.col("l_linestatus") == flag)
    return l.select((F.col("l_orderkey") % 1000).alias("subject"), (F.col("l_partkey") % 12).alias("value"), F.when(F.col("l_suppkey") % 4 == 0, "kg").otherwise("g").alias("unit"))


D_AMOUNTS = "am AS (SELECT l_orderkey % 1000 AS subject, l_partkey % 12 AS value, CASE WHEN l_suppkey % 4 = 0 THEN 'kg' ELSE 'g' END AS unit, l_linestatus AS f FROM lineitem)"


def _substances(s, d):
    p = views.table(s, d, "part")
    base = p.select(F.col("p_name").alias("name"), F.concat(F.lit("no "), F.lpad((F.col("p_partkey") % 90 + 10).cast("string"), 2, "0"), F.lit("-11-"), (F.col("p_partkey") % 10).cast("string"), F.when(F.col("p_partkey") % 2 == 0, " and 50-00-0").otherwise("")).alias("cas"), F.col("p_brand").alias("brand"))
    return ingest.load_substance_lists({"l1": base.where(F.col("brand") < "Brand#2"), "l2": base.where(F.col("brand") >= "Brand#2").drop("brand")})


D_SUBST = r"""b AS (SELECT p_name AS name, 'no ' || lpad(CAST(p_partkey % 90 + 10 AS VARCHAR), 2, '0') || '-11-' || CAST(p_partkey % 10 AS VARCHAR) || CASE WHEN p_partkey % 2 = 0 THEN ' and 50-00-0' ELSE '' END AS cell, p_brand FROM part),
subst AS (SELECT CASE WHEN p_brand < 'Brand#2' THEN 'l1' ELSE 'l2' END AS list_name, name, unnest(regexp_extract_all(cell, '\d{2,7}-\d{2}-\d')) AS cas, CASE WHEN p_brand < 'Brand#2' THEN 'brand=' || p_brand ELSE '' END AS detail FROM b)"""

QUERIES = {
    "active_asset": (
        lambda s, d: ingest.active_asset(_history(s, d)).select("asset", F.col("payload").cast("double").alias("payload"), "updated_at"),
        f"WITH {D_HISTORY} SELECT asset, first(p ORDER BY updated_at DESC, version DESC) AS payload, max(updated_at) AS updated_at FROM h WHERE is_active GROUP BY asset",
    ),
    "publish_asset": (
        lambda s, d: ingest.publish_asset(_history(s, d), _incoming(s, d)).groupBy("asset").agg(F.count(F.lit(1)).alias("versions"), F.count_if("is_active").alias("active"), F.max_by("version", F.struct("is_active", "version")).alias("current")),
        f"""WITH {D_HISTORY}, i AS (SELECT DISTINCT 'a' || CAST(o_custkey % 50 AS VARCHAR) AS asset FROM orders WHERE o_custkey % 50 < 20 AND year(o_orderdate) = 2000),
        a AS (SELECT asset, version, is_active AND asset NOT IN (SELECT asset FROM i) AS is_active FROM h WHERE NOT (version = 2000 AND asset IN (SELECT asset FROM i)) UNION ALL SELECT asset, 2000, true FROM i)
        SELECT asset, count(*) AS versions, count_if(is_active) AS active, first(version ORDER BY is_active DESC, version DESC) AS current FROM a GROUP BY asset""",
    ),
    "upsert": (
        lambda s, d: ingest.upsert(views.table(s, d, "orders").where("o_orderkey % 2 = 0").select("o_custkey", "o_orderpriority", "o_orderkey"), views.table(s, d, "orders").where("o_orderkey % 2 = 1 AND o_custkey % 3 = 0").select("o_custkey", "o_orderpriority", "o_orderkey"), ["o_custkey", "o_orderpriority"], "o_orderkey"),
        """WITH b AS (SELECT o_custkey, o_orderpriority, o_orderkey, 1 - o_orderkey % 2 AS p FROM orders WHERE o_orderkey % 2 = 0 OR o_custkey % 3 = 0), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY p, o_orderkey DESC) AS r FROM b)
        SELECT o_custkey, o_orderpriority, o_orderkey FROM r WHERE r = 1""",
    ),
    "insert_absent": (
        lambda s, d: ingest.insert_absent(views.table(s, d, "orders").where("o_orderkey % 3 = 0").select("o_custkey", "o_orderkey"), views.table(s, d, "orders").where("o_orderkey % 3 = 1").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.col("o_orderkey")]),
        """WITH t AS (SELECT o_custkey, o_orderkey FROM orders WHERE o_orderkey % 3 = 0) SELECT * FROM t UNION ALL SELECT o_custkey, min(o_orderkey) FROM orders WHERE o_orderkey % 3 = 1 AND o_custkey NOT IN (SELECT o_custkey FROM t) GROUP BY o_custkey""",
    ),
    "merge_scope": (
        lambda s, d: ingest.merge_scope(views.goods(s, d).groupBy(F.left("code10", F.lit(2)).alias("chapter")).agg(F.array_join(F.collect_set(F.substring("code10", 3, 2)), "/").alias("scope")), views.goods(s, d).where("p_partkey % 50 = 0").select(F.left("code10", F.lit(2)).alias("chapter"), F.substring("code10", 5, 2).alias("scope")), "chapter"),
        f"""{views.WITH_GOODS}, x AS (SELECT substr(code10, 1, 2) AS chapter, substr(code10, 3, 2) AS v FROM goods UNION SELECT substr(code10, 1, 2), substr(code10, 5, 2) FROM goods WHERE p_partkey % 50 = 0) SELECT chapter, string_agg(v, '/' ORDER BY v) AS scope FROM x GROUP BY chapter""",
    ),
    "run_checks": (
        lambda s, d: ingest.run_checks(views.table(s, d, "nation"), {"rows": (F.lit(True), 25), "first region": (F.col("n_regionkey") == 0, 5), "no name": (F.col("n_name").isNull(), 1)}),
        """SELECT 'rows' AS name, count(*) = 25 AS ok, count(*) || ' of 25' AS detail FROM nation UNION ALL SELECT 'first region', count_if(n_regionkey = 0) = 5, count_if(n_regionkey = 0) || ' of 5' FROM nation UNION ALL SELECT 'no name', count_if(n_name IS NULL) = 1, count_if(n_name IS NULL) || ' of 1' FROM nation""",
    ),
    "code_gap": (
        lambda s, d: ingest.code_gap(views.goods(s, d).select(F.col("code10").alias("code")), views.goods(s, d).where("p_partkey % 4 <> 1").select(F.col("code10").alias("code"))),
        f"""{views.WITH_GOODS}, g AS (SELECT DISTINCT code10 AS code FROM goods WHERE code10 NOT IN (SELECT code10 FROM goods WHERE p_partkey % 4 <> 1)) SELECT (SELECT count(*) FROM g) AS n, (SELECT string_agg(code, ';' ORDER BY code) FROM (SELECT code FROM g ORDER BY code LIMIT 20)) AS first""",
    ),
    "substance_lists": (_substances, f"WITH {D_SUBST} SELECT * FROM subst"),
    "screen_substances": (
        lambda s, d: ingest.screen_substances(views.table(s, d, "part").select(F.col("p_partkey").alias("entry_id"), F.upper("p_name").alias("name"), F.when(F.col("p_partkey") % 5 == 0, F.concat((F.col("p_partkey") % 90 + 10).cast("string"), F.lit("-11-3"))).alias("cas")), _substances(s, d)),
        rf"""WITH {D_SUBST}, e AS (SELECT p_partkey AS entry_id, p_name AS name, CASE WHEN p_partkey % 5 = 0 THEN CAST(p_partkey % 90 + 10 AS VARCHAR) || '-11-3' END AS cas FROM part),
        c AS (SELECT DISTINCT entry_id, list_name, 'cas' AS how FROM e JOIN subst USING (cas)) SELECT * FROM c UNION ALL SELECT DISTINCT entry_id, list_name, 'name' FROM e JOIN subst ON e.name = subst.name WHERE entry_id NOT IN (SELECT entry_id FROM c)""",
    ),
    "name_dictionary": (
        lambda s, d: ingest.build_name_dictionary(views.goods(s, d).select(F.concat(F.lit(" "), "label").alias("ko"), F.upper("label").alias("en"), "code10", F.col("p_partkey").alias("pos")), ["red widget"]),
        f"{views.WITH_GOODS} SELECT label AS ko, label AS en, substr(code10, 1, 6) AS hs6, arg_min(code10, p_partkey) AS code10, min(p_partkey) AS pos FROM goods WHERE label <> 'red widget' AND NOT starts_with(label, 'other') GROUP BY ALL",
    ),
    "recall": (
        lambda s, d: evaluate.recall(_preds(s, d), views.goods(s, d).select(F.col("p_partkey").alias("case_id"), "code10")),
        f"""{views.WITH_GOODS}, {D_PREDS}, e AS (SELECT level, case_id, bool_or(rank = 1 AND substr(code10, 1, level) = substr(truth, 1, level)) AS t1, bool_or(rank <= 5 AND substr(code10, 1, level) = substr(truth, 1, level)) AS tk FROM p, (VALUES (2), (4), (6), (8), (10)) AS v(level) GROUP BY ALL)
        SELECT level, count(*) AS evaluated, count_if(t1) AS top1, count_if(tk) AS topk, round(count_if(t1) / count(*), 6) AS top1_ratio, round(count_if(tk) / count(*), 6) AS topk_ratio FROM e GROUP BY level""",
    ),
    "table_agreement": (
        lambda s, d: evaluate.table_agreement(_cells(s, d, "O"), _cells(s, d, "F")),
        """WITH c AS (SELECT l_orderkey % 500 AS table_id, l_returnflag || CAST(l_linenumber AS VARCHAR) AS cell, count_if(l_linestatus = 'O') AS a, count_if(l_linestatus = 'F') AS b FROM lineitem GROUP BY ALL), g AS (SELECT table_id, sum(least(a, b)) AS k, sum(a) AS na, sum(b) AS nb FROM c GROUP BY table_id)
        SELECT table_id, round(k / nullif(nb, 0), 6) AS precision, round(k / nullif(na, 0), 6) AS recall, round(2 * k / (na + nb), 6) AS f1 FROM g""",
    ),
    "fact_agreement": (
        lambda s, d: evaluate.fact_agreement(views.table(s, d, "lineitem").select(F.concat("l_returnflag", "l_linestatus", (F.col("l_linenumber") % 3).cast("string")).alias("route"), (F.col("l_partkey") * 7 % 1500).alias("fact"))),
        """WITH f AS (SELECT DISTINCT l_returnflag || l_linestatus || CAST(l_linenumber % 3 AS VARCHAR) AS route, l_partkey * 7 % 1500 AS fact FROM lineitem), n AS (SELECT route, count(*) AS n FROM f GROUP BY route),
        s AS (SELECT a.route, b.route AS other, count(*) AS shared FROM f a JOIN f b ON a.fact = b.fact AND a.route < b.route GROUP BY ALL) SELECT s.route, other, shared, round(shared / (x.n + y.n - shared), 6) AS jaccard FROM s JOIN n x ON x.route = s.route JOIN n y ON y.route = other""",
    ),
    "observe_bindings": (lambda s, d: evaluate.observe_bindings(_observations(s, d)), f"WITH {D_OBS} SELECT * FROM m"),
    "qualified_bindings": (
        lambda s, d: evaluate.qualified_bindings(evaluate.observe_bindings(_observations(s, d)), 10, 0.3),
        f"""WITH {D_OBS} SELECT axis, field, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN supports THEN n ELSE 0 END) AS BIGINT) AS good, round(sum(CASE WHEN supports THEN n ELSE 0 END) / sum(n), 6) AS precision FROM m WHERE verdict = 'true' GROUP BY ALL HAVING sum(n) >= 10 AND round(sum(CASE WHEN supports THEN n ELSE 0 END) / sum(n), 6) >= 0.3""",
    ),
    "compare_quantities": (
        lambda s, d: evaluate.compare_quantities(_amounts(s, d, "O"), _amounts(s, d, "F")),
        f"""WITH {D_AMOUNTS}, g AS (SELECT subject, value, count_if(f = 'O') > 0 AND count_if(f = 'F') > 0 AS bth, len(list_intersect(coalesce(list(DISTINCT unit) FILTER (f = 'O'), []), coalesce(list(DISTINCT unit) FILTER (f = 'F'), []))) > 0 AS same FROM am GROUP BY ALL)
        SELECT subject, count_if(bth) AS shared, count(*) AS n, CASE WHEN count_if(bth AND NOT same) > 0 THEN 'conflict' WHEN count_if(bth) * 2 < count(*) THEN 'mismatch' ELSE 'ok' END AS verdict FROM g GROUP BY subject""",
    ),
    "dedupe_boxes": (
        lambda s, d: evaluate.dedupe_boxes(_boxes(s, d)).select("page", "box_id"),
        f"""WITH RECURSIVE b AS (SELECT *, regexp_replace(text, '\\s+', ' ', 'g') AS t, row_number() OVER (PARTITION BY page ORDER BY box_id) AS k FROM ({BOXES.replace("<S>", "VARCHAR").replace("{lineitem}", "lineitem")})),
        g AS (SELECT page, k, [{{'i': box_id, 'x1': x1, 'y1': y1, 'x2': x2, 'y2': y2, 't': t}}] AS kept FROM b WHERE k = 1
          UNION ALL SELECT g.page, b.k, CASE WHEN len(list_filter(g.kept, lambda o: (b.t <> '' AND o.t = b.t)
            OR greatest(0, least(o.x2, b.x2) - greatest(o.x1, b.x1)) * greatest(0, least(o.y2, b.y2) - greatest(o.y1, b.y1)) >= 0.65 * ((o.x2 - o.x1) * (o.y2 - o.y1) + (b.x2 - b.x1) * (b.y2 - b.y1)
              - greatest(0, least(o.x2, b.x2) - greatest(o.x1, b.x1)) * greatest(0, least(o.y2, b.y2) - greatest(o.y1, b.y1))))) > 0 THEN g.kept
            ELSE list_append(g.kept, {{'i': b.box_id, 'x1': b.x1, 'y1': b.y1, 'x2': b.x2, 'y2': b.y2, 't': b.t}}) END FROM g JOIN b ON b.page = g.page AND b.k = g.k + 1),
        z AS (SELECT page, arg_max(kept, k) AS kept FROM g GROUP BY page)
        SELECT page, unnest(kept).i AS box_id FROM z""",
    ),
    "review_queue": (
        lambda s, d: runs.run_to_end(runs.review_queue(_stream(s, d).select("event_id", "ts", (F.col("user_id") % 40).alias("term"), F.concat("event_type", F.lit(":"), F.col("user_id").cast("string")).alias("raw"))), ["term"]),
        "SELECT user_id % 40 AS term, min(ts) AS first_seen, max(ts) AS last_seen, count(*) AS n, first(event_type || ':' || user_id ORDER BY ts DESC, event_id DESC) AS last_raw FROM events GROUP BY 1",
    ),
    "run_state": (
        lambda s, d: runs.run_to_end(runs.run_state(_stream(s, d).select(F.col("user_id").alias("run"), F.col("event_type").alias("status"), "ts", "event_id")), ["run"]),
        "SELECT user_id AS run, first(event_type ORDER BY ts DESC, event_id DESC) AS status, max(event_id) AS last_event FROM events GROUP BY 1",
    ),
    "case_status": (
        lambda s, d: runs.run_to_end(runs.case_status(_stream(s, d).select((F.col("user_id") % 25).alias("case_id"), F.get_json_object("props", "$.k").alias("document"), F.col("event_type").alias("action"), "ts", "event_id")), ["case_id", "document"]),
        "SELECT user_id % 25 AS case_id, json_extract_string(props, '$.k') AS document, first(event_type ORDER BY ts DESC, event_id DESC) AS action, count(*) AS n FROM events GROUP BY ALL",
    ),
    "event_counts": (
        lambda s, d: runs.run_to_end(runs.event_counts(_stream(s, d).withColumn("ts", F.col("ts").cast("timestamp"))).select(F.col("w.start").alias("start"), "event_type", "n", F.round("total", 4).alias("total")), ["start", "event_type"]),
        "SELECT time_bucket(INTERVAL '1 hour', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    ),
    "active_requests": (
        lambda s, d: runs.append_to_end(runs.active_requests(_signed(_stream(s, d)))),
        """WITH e AS (SELECT user_id % 60 AS signature, event_id, event_type = 'purchase' AS closed FROM events), p AS (SELECT *, lag(closed) OVER (PARTITION BY signature ORDER BY event_id) AS before FROM e) SELECT signature, event_id FROM p WHERE NOT closed AND (before IS NULL OR before)""",
    ),
    "image_status": (
        lambda s, d: views.table(s, d, "events").groupBy((F.col("event_id") % 700).alias("image")).agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status")).groupBy("status").agg(F.count(F.lit(1)).alias("n")),
        "WITH l AS (SELECT event_id % 700 AS image, first(event_type ORDER BY ts DESC, event_id DESC) AS status FROM events GROUP BY 1) SELECT status, count(*) AS n FROM l GROUP BY status",
    ),
    "cosine_top_k": (
        lambda s, d: hooks.cosine_top_k(views.table(s, d, "embeddings").where("vec_id % 20 = 0"), views.table(s, d, "embeddings")),
        """WITH q AS (SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
        k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS place FROM q) SELECT * FROM k WHERE place <= 5""",
    ),
}
