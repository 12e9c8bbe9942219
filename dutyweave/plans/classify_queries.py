"""Registered queries on verdicts, scores and choices, with their SQL twins."""

from __future__ import annotations

from dutyweave.operators import classify as ops
from dutyweave.plans import views
from pyspark.sql import functions as F

VERDICTS = """SELECT l_orderkey AS product, 'c' || CAST(l_suppkey % 3 AS <S>) AS code, l_orderkey * 100 + l_linenumber * 10 + l_suppkey % 7 AS row_id, l_linenumber,
  CASE l_returnflag WHEN 'A' THEN true WHEN 'N' THEN CAST(NULL AS BOOLEAN) ELSE l_linenumber % 4 = 0 END AS verdict,
  CASE WHEN l_partkey % 3 = 0 THEN '' ELSE 'g' || CAST(l_linenumber % 2 AS <S>) END AS alt_group,
  CASE l_linenumber WHEN 1 THEN 'field' WHEN 2 THEN 'pool' WHEN 3 THEN 'block' WHEN 4 THEN 'confirmed' ELSE 'partial' END AS kind FROM {lineitem}"""
RANKED = """SELECT DISTINCT l_orderkey AS product, substr(code10, 1, 4) AS code, substr(code10, 1, 2) AS parent, substr(code10, 3, 2) = '00' AS residual,
  CASE (l_orderkey + CAST(substr(code10, 3, 2) AS INT)) % 3 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'violated' ELSE 'undecided' END AS decision,
  CAST((l_orderkey * 7 + CAST(substr(code10, 1, 4) AS INT)) % 13 AS INT) AS score, CAST(CAST(substr(code10, 1, 2) AS INT) * 5 % 11 AS INT) AS parent_score
  FROM {lineitem} JOIN {goods} ON l_partkey = p_partkey"""
RULINGS = """SELECT doc_id AS ref, code10, substr(code10, 1, 4) AS prefix, <SPLIT>(lower(<LINE>), '[^a-z]+') AS toks FROM {documents} JOIN {goods} ON p_partkey = doc_id % 2000"""


def duck(text: str) -> str:
    return views.for_duckdb(text).replace("{documents}", "documents").replace("<SPLIT>", "string_split_regex").replace("<LINE>", "text")


def rulings(s, d):
    text = RULINGS.replace("<SPLIT>", "split").replace("<LINE>", "text")
    r = s.sql(text, documents=views.table(s, d, "documents"), goods=views.goods(s, d))
    return r.withColumn("toks", F.array_distinct(F.filter("toks", lambda w: F.length(w) >= 3))).where(F.size("toks") > 0)


D_RULINGS = f"""raw AS ({duck(RULINGS)}), rulings AS (SELECT ref, code10, prefix, list_distinct(list_filter(toks, lambda w: length(w) >= 3)) AS toks FROM raw WHERE len(list_filter(toks, lambda w: length(w) >= 3)) > 0)"""


def verdicts(s, d):
    return s.sql(views.for_spark(VERDICTS), lineitem=views.table(s, d, "lineitem"))


def ranked(s, d):
    return s.sql(views.for_spark(RANKED), lineitem=views.table(s, d, "lineitem"), goods=views.goods(s, d))


D_RANKED = f"{views.WITH_GOODS}, ranked AS ({views.for_duckdb(RANKED)})"
D_ROLL = f"""WITH v AS ({views.for_duckdb(VERDICTS)}), o AS (SELECT product, code, CASE WHEN alt_group = '' THEN 'row:' || row_id ELSE alt_group END AS g, count_if(verdict) AS t, count_if(NOT verdict) AS f, count(*) AS n FROM v GROUP BY ALL),
u AS (SELECT product, code, CASE WHEN t > 0 THEN 1 WHEN f = n THEN -1 ELSE 0 END AS x FROM o)
SELECT product, code, CASE WHEN min(x) = -1 THEN 'violated' WHEN min(x) = 1 THEN 'confirmed' ELSE 'undecided' END AS decision FROM u GROUP BY ALL"""


def _cascade(level: int):
    def run(s, d):
        r = ranked(s, d)
        if level == 6:
            r = r.withColumn("code", F.concat("parent", "code")).select("product", "code", "residual", "decision")
        return ops.general_rule_cascade(r.select("product", "code", "residual", "decision"), r.where("product % 4 = 0 AND substr(code, -1) = '5'").select("product", "code"), level)

    return run


def _d_cascade(level: int) -> str:
    code, by = ("code", "product") if level == 4 else ("parent || code", "product, substr(code, 1, 4)")
    family, last = ("gri3", "gri3c_last_numeric") if level == 4 else ("gri6", "none")
    return f"""{D_RANKED}, r AS (SELECT product, {code} AS code, residual, product % 4 = 0 AND suffix({code}, '5') AS known FROM ranked WHERE decision = 'confirmed'),
    c AS (SELECT *, count(*) OVER w AS n, count_if(NOT residual) OVER w AS ns, count_if(known) OVER w AS nk, max(code) OVER w AS mx FROM r WINDOW w AS (PARTITION BY {by})),
    e AS (SELECT product, code, CASE WHEN ns = 1 THEN '{family}a_most_specific' WHEN nk = 1 THEN '{family}_precedent' ELSE '{family}c_last_numeric' END AS rule, CASE WHEN ns = 1 THEN NOT residual WHEN nk = 1 THEN known ELSE code = mx END AS wins FROM c WHERE n > 1)
    SELECT *, NOT wins AND rule <> '{last}' AS loses FROM e"""


def _facts(s, d):
    p = views.table(s, d, "part")
    return p.select(F.col("p_partkey").alias("product"), F.explode(F.split("p_name", " ")).alias("word"), (1 + F.col("p_partkey") % 3).cast("double").alias("weight"))


def _children(s, d):
    p = views.table(s, d, "part")
    return p.select(F.col("p_type").alias("parent"), F.col("p_brand").alias("code"), F.explode(F.split("p_name", " ")).alias("word"), (F.col("p_size") % 9 == 0).alias("excluded"))


def _details(s, d):
    c = views.table(s, d, "conversations")
    return c.select("conv_id").distinct().select(
        F.col("conv_id").alias("question_key"), F.when(F.col("conv_id") % 5 == 0, True).alias("verdict"), F.when(F.col("conv_id") % 2 == 0, "not_contains").otherwise("contains").alias("op")
    )


def _answers(s, d):
    c = views.table(s, d, "conversations")
    n = F.length("text") % 4
    return c.select(F.col("conv_id").alias("question_key"), F.when(n == 0, "yes").when(n == 1, "no").when(n == 2, "unknown").otherwise("maybe").alias("answer"), F.col("turn").alias("answered_at"))


def _products(s, d):
    b = views.table(s, d, "benchmark").withColumnRenamed("item_id", "product").withColumn("p_partkey", F.col("product"))
    b = b.join(views.goods(s, d), "p_partkey")
    return b.select("product", "code10", F.left("code10", F.lit(4)).alias("prefix"), F.array_distinct(F.filter(F.split(F.lower("text"), "[^a-z]+"), lambda w: F.length(w) >= 3)).alias("toks"))


D_PRODUCTS = "products AS (SELECT item_id AS product, code10, substr(code10, 1, 4) AS prefix, list_distinct(list_filter(string_split_regex(lower(text), '[^a-z]+'), lambda w: length(w) >= 3)) AS toks FROM benchmark JOIN goods ON p_partkey = item_id)"

QUERIES = {
    "roll_up": (lambda s, d: ops.roll_up(verdicts(s, d), ["product", "code"]), D_ROLL),
    "additive_scores": (
        lambda s, d: ops.additive_scores(verdicts(s, d), ["product", "code"]),
        f"""WITH v AS ({views.for_duckdb(VERDICTS)}) SELECT product, code, CAST(sum(CASE kind WHEN 'field' THEN 3 WHEN 'pool' THEN 1 WHEN 'block' THEN -100 WHEN 'confirmed' THEN 50 ELSE 0 END) + least(2, count_if(kind = 'partial')) * 3 AS BIGINT) AS score FROM v GROUP BY ALL""",
    ),
    "lexical_scores": (
        lambda s, d: ops.lexical_scores(_facts(s, d), _children(s, d)),
        """WITH f AS (SELECT p_partkey AS product, w AS word, max(1 + p_partkey % 3)::DOUBLE AS weight FROM (SELECT *, unnest(string_split(p_name, ' ')) AS w FROM part) GROUP BY ALL),
        c AS (SELECT DISTINCT p_type AS parent, p_brand AS code, unnest(string_split(p_name, ' ')) AS word, p_size % 9 = 0 AS excluded FROM part),
        n AS (SELECT parent, count(DISTINCT code) AS n FROM c GROUP BY parent), h AS (SELECT parent, word FROM c JOIN n USING (parent) WHERE NOT excluded GROUP BY parent, word, n HAVING count(*) * 2 <= n)
        SELECT product, parent, code, round(sum(CASE WHEN excluded THEN -0.5 ELSE weight END), 2) AS score FROM c JOIN f USING (word) WHERE excluded OR (parent, word) IN (SELECT (parent, word) FROM h) GROUP BY product, parent, code""",
    ),
    "gri_cascade_4": (_cascade(4), _d_cascade(4)),
    "gri_cascade_6": (_cascade(6), _d_cascade(6)),
    "authoritative_selection": (
        lambda s, d: ops.authoritative_selection(ranked(s, d).select("product", "parent", "code", "residual", "decision")),
        f"""{D_RANKED}, g AS (SELECT product, parent, count_if(decision = 'confirmed') AS c, count_if(NOT residual) AS named, count_if(NOT residual AND decision = 'violated') AS gone, count_if(residual) AS rest,
          min(CASE WHEN decision = 'confirmed' THEN code END) AS conf, min(CASE WHEN residual AND decision <> 'violated' THEN code END) AS lft FROM ranked GROUP BY ALL)
        SELECT product, parent, CASE WHEN c = 1 THEN conf WHEN c = 0 AND named = gone AND rest = 1 THEN lft END AS selected,
          CASE WHEN c = 1 THEN 'confirmed' WHEN c > 1 THEN 'several_confirmed' WHEN named = gone AND rest = 1 AND lft IS NOT NULL THEN 'residual_by_elimination' ELSE 'open' END AS why FROM g""",
    ),
    "overlay_answers": (
        lambda s, d: ops.overlay_answers(_details(s, d), _answers(s, d)),
        """WITH a AS (SELECT conv_id, arg_max(CASE length(text) % 4 WHEN 0 THEN true WHEN 1 THEN false END, turn) AS x, arg_max(length(text) % 4, turn) AS k FROM conversations WHERE length(text) % 4 < 3 GROUP BY conv_id)
        SELECT conv_id AS question_key, CASE WHEN conv_id % 5 = 0 THEN true WHEN k = 0 THEN conv_id % 2 = 1 WHEN k = 1 THEN conv_id % 2 = 0 END AS verdict, CASE WHEN conv_id % 2 = 0 THEN 'not_contains' ELSE 'contains' END AS op
        FROM (SELECT DISTINCT conv_id FROM conversations) LEFT JOIN a USING (conv_id)""",
    ),
    "inherit_violation": (
        lambda s, d: ops.inherit_violation(ranked(s, d).select("product", "parent", "code", "decision", "score"), ranked(s, d).select("product", F.col("parent").alias("code"), "decision").distinct()),
        f"""{D_RANKED}, p AS (SELECT DISTINCT product, parent, true AS gone FROM ranked WHERE decision = 'violated'), j AS (SELECT product, parent, code, CASE WHEN gone THEN 'violated' ELSE decision END AS decision, score, coalesce(gone, false) AS gone FROM ranked LEFT JOIN p USING (product, parent))
        SELECT product, parent, code, decision, score, row_number() OVER (PARTITION BY product ORDER BY gone, score DESC, code) AS place FROM j""",
    ),
    "route_disagreements": (
        lambda s, d: ops.route_disagreements(ranked(s, d).select("product", "parent", "code", "score", "parent_score")),
        f"""{D_RANKED}, b AS (SELECT product, parent, max(parent_score) AS ps FROM ranked GROUP BY ALL), l AS (SELECT product, first(parent ORDER BY ps DESC, parent DESC) AS leader FROM b GROUP BY product),
        j AS (SELECT r.*, leader, max(CASE WHEN parent = leader THEN score END) OVER (PARTITION BY product) AS bar FROM ranked r JOIN l USING (product)),
        k AS (SELECT product, leader, code, score, row_number() OVER (PARTITION BY product ORDER BY score DESC, code) AS place FROM j WHERE parent <> leader AND score >= bar) SELECT * FROM k WHERE place <= 5""",
    ),
    "similar_rulings": (
        lambda s, d: ops.similar_rulings(_products(s, d), rulings(s, d)),
        f"""{views.WITH_GOODS}, {D_RULINGS}, {D_PRODUCTS}, p AS (SELECT product, unnest(toks) AS tok, code10 FROM products), r AS (SELECT ref, unnest(toks) AS tok, code10 FROM rulings),
        t AS (SELECT product, ref, tier, count(*) AS shared FROM p JOIN r USING (tok), (VALUES (0, 8), (1, 6), (2, 4)) AS w(tier, n) WHERE substr(p.code10, 1, n) = substr(r.code10, 1, n) GROUP BY ALL),
        m AS (SELECT *, min(tier) OVER (PARTITION BY product) AS best FROM t), k AS (SELECT product, ref, tier, shared, row_number() OVER (PARTITION BY product ORDER BY shared DESC, ref) AS place FROM m WHERE tier = best) SELECT * FROM k WHERE place <= 3""",
    ),
    "bm25_shortlist": (
        lambda s, d: ops.bm25_shortlist(_products(s, d), rulings(s, d)),
        f"""{views.WITH_GOODS}, {D_RULINGS}, {D_PRODUCTS}, st AS (SELECT count(*) AS docs, avg(len(toks)) AS mean FROM rulings), r AS (SELECT ref, prefix, unnest(toks) AS tok, len(toks) AS dl FROM rulings), df AS (SELECT tok, count(*) AS df FROM r GROUP BY tok),
        q AS (SELECT product, prefix, unnest(toks) AS tok FROM products), z AS (SELECT product, ref, round(sum(ln(1 + (docs - df + 0.5) / (df + 0.5)) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * dl / mean))), 6) AS score FROM q JOIN df USING (tok) JOIN r USING (prefix, tok), st GROUP BY ALL),
        k AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY score DESC, ref) AS place FROM z) SELECT * FROM k WHERE place <= 20""",
    ),
    "questions": (
        lambda s, d: ops.questions(verdicts(s, d).where("verdict IS NULL").select("product", F.col("code").alias("field"), F.col("kind").alias("value"))),
        f"""WITH v AS (SELECT DISTINCT product, code AS field, kind AS value FROM ({views.for_duckdb(VERDICTS)}) WHERE verdict IS NULL), k AS (SELECT *, sha256('["' || field || '","' || value || '"]') AS question_key FROM v),
        n AS (SELECT *, row_number() OVER (PARTITION BY product ORDER BY question_key) AS place FROM k) SELECT * FROM n WHERE place <= 8""",
    ),
    "precedent_tiebreak": (
        lambda s, d: ops.tie_break(ranked(s, d).select("product", "parent", "code", "decision", (F.col("score") * 0).alias("score")), views.table(s, d, "part").select(F.lpad((F.col("p_partkey") % 25 * 100 + F.col("p_partkey") % 10).cast("string"), 4, "0").alias("code"), F.col("p_brand").alias("ref"))),
        f"""{D_RANKED}, v AS (SELECT lpad(CAST(p_partkey % 25 * 100 + p_partkey % 10 AS VARCHAR), 4, '0') AS code, count(DISTINCT p_brand) AS n_refs FROM part GROUP BY 1),
        j AS (SELECT product, parent, code, n_refs, count_if(decision = 'undecided') OVER w = count(*) OVER w AS tied, count_if(coalesce(n_refs >= 2, false)) OVER w AS n_ok FROM ranked LEFT JOIN v USING (code) WINDOW w AS (PARTITION BY product, parent))
        SELECT product, parent, code, n_refs FROM j WHERE tied AND n_refs >= 2 AND n_ok = 1""",
    ),
    "top_k": (
        lambda s, d: ops.top_k(ranked(s, d).select("product", "code", "score"), ["product"], [F.desc("score"), F.col("code")], 2),
        f"{D_RANKED}, k AS (SELECT product, code, score, row_number() OVER (PARTITION BY product ORDER BY score DESC, code) AS place FROM ranked) SELECT * FROM k WHERE place <= 2",
    ),
}
