"""Registered queries on duties, measures and requirements, with their SQL twins."""

from __future__ import annotations

from dutyweave.functions import codes, duty
from dutyweave.operators import requirements as ops
from dutyweave.plans import views
from pyspark.sql import functions as F

ANC = """anc AS (SELECT DISTINCT code10, unnest([code10, substr(code10,1,8)||'00', substr(code10,1,6)||'0000', substr(code10,1,4)||'000000', substr(code10,1,2)||'00000000']) AS goods_code_10 FROM goods)"""
NEAR = "CASE WHEN goods_code_10 = code10 THEN 1 ELSE 0 END, length(rtrim(goods_code_10, '0'))"
RATE = "coalesce(TRY_CAST(replace(nullif(regexp_extract(duty_text, '(\\d+(?:[.,]\\d+)?)\\s*%', 1), ''), ',', '.') AS DOUBLE), 0)"
BUCKET = "CASE measure_type_code WHEN '143' THEN 'conditional' WHEN '142' THEN 'fta' WHEN '103' THEN 'basic' ELSE 'conditional' END"
BRANCH = """per_kind AS (SELECT goods_code_10, measure_type_code, min(measure_id) AS first, count(*) AS n, bool_or(applies) AS applies FROM measures GROUP BY ALL),
branches AS (SELECT goods_code_10, string_agg(measure_type_code, ';' ORDER BY first, measure_type_code) AS kinds, CAST(sum(n) AS BIGINT) AS n_measures, bool_or(applies) AS applies,
  NOT suffix(goods_code_10, '00') AS leaf, substr(goods_code_10, 1, 4) AS heading FROM per_kind GROUP BY goods_code_10)"""
DOCS = [("health certificate", "02-05;16"), ("plant passport", "06-14"), ("origin statement", "ALL"), ("wood declaration", "44, 20-22"), ("none", "77")]
REQS = [("q1", "C-0001", "103", ""), ("q2", "C-0002", "", ""), ("q3", "", "142", ""), ("q4", "C-0003", "143", "R0003"), ("q5", "Y-0004", "", "")]
CHAPTERS = [(f"{c:02d}", d) for c, d in [(1, "live animals"), (2, "food"), (3, "food"), (4, "food"), (5, "animal products"), (7, "plants"), (8, "plants"), (15, "food"), (15, "chemicals"), (22, "drinks")]]


def values(rows: list[tuple], names: str) -> str:
    def one(v: object) -> str:
        return "NULL" if v is None else str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int | float) else "'" + str(v).replace("'", "''") + "'"

    return f"(VALUES {', '.join('(' + ', '.join(one(v) for v in r) + ')' for r in rows)}) AS t({names})"


def _groups(s, d):
    m = views.measures(s, d)
    g = m.select("measure_type_code", "legal_base", F.concat(F.when(F.col("measure_id") % 7 == 0, "Y").when(F.col("measure_id") % 7 == 1, "N").when(F.col("measure_id") % 7 == 2, "L").when(F.col("measure_id") % 7 == 3, "u").when(F.col("measure_id") % 7 == 4, "D").otherwise("C"), F.lit("-000"), (F.col("measure_id") % 5).cast("string")).alias("certificate"))
    return g.distinct()


GROUPS = "grp AS (SELECT DISTINCT measure_type_code, legal_base, CASE measure_id % 7 WHEN 0 THEN 'Y' WHEN 1 THEN 'N' WHEN 2 THEN 'L' WHEN 3 THEN 'u' WHEN 4 THEN 'D' ELSE 'C' END || '-000' || CAST(measure_id % 5 AS VARCHAR) AS certificate FROM measures)"


def _details(s, d):
    o = views.table(s, d, "orders")
    k = F.col("o_orderkey")
    return o.select(
        k.alias("subject"), F.col("o_orderpriority").alias("detail"),
        F.when(k % 3 == 0, "weight;origin").when(k % 3 == 1, "origin").otherwise("").alias("required"),
        F.when(k % 4 == 0, "permit").otherwise("").alias("blocking"),
        (k % 11 == 0).alias("negative"), (k % 5 == 0).alias("exemption"), (k % 10 == 0).alias("exemption_applies"),
        F.when(k % 7 == 0, "true").otherwise("false").alias("external"), F.when(k % 2 == 0, "mandatory").otherwise("optional").alias("level"),
    )


def _facts(s, d):
    o = views.table(s, d, "orders")
    return o.select(F.col("o_orderkey").alias("subject"), F.when(F.col("o_orderstatus") == "F", "permit").when(F.col("o_orderstatus") == "O", "origin").otherwise("weight").alias("fact"))


DETAILS = """det AS (SELECT o_orderkey AS subject, o_orderpriority AS detail, CASE o_orderkey % 3 WHEN 0 THEN 'weight;origin' WHEN 1 THEN 'origin' ELSE '' END AS required,
  CASE WHEN o_orderkey % 4 = 0 THEN 'permit' ELSE '' END AS blocking, o_orderkey % 11 = 0 AS negative, o_orderkey % 5 = 0 AS exemption, o_orderkey % 10 = 0 AS exemption_applies,
  o_orderkey % 7 = 0 AS external, o_orderkey % 2 = 0 AS mandatory, CASE o_orderstatus WHEN 'F' THEN 'permit' WHEN 'O' THEN 'origin' ELSE 'weight' END AS fact FROM orders),
mis AS (SELECT *, CASE WHEN required = '' THEN 0 ELSE len(list_filter(string_split(required, ';'), lambda x: x <> fact)) END AS need, CASE WHEN blocking <> '' AND blocking <> fact THEN 1 ELSE 0 END AS block FROM det),
decided AS (SELECT subject, detail, CASE WHEN negative OR (exemption AND exemption_applies) THEN 'exempted' WHEN block > 0 THEN 'pending' WHEN exemption THEN 'conditional' WHEN external THEN 'conditional'
  WHEN mandatory THEN 'required' WHEN need > 0 THEN 'conditional' ELSE 'required' END AS status, need + block AS n_missing FROM mis)"""


def _decided(s, d):
    return ops.decide_requirements(_details(s, d), _facts(s, d))


def _branches(s, d):
    return ops.resolve_branches(views.measures(s, d))


def _inherited(s, d):
    return ops.inherit_measures(views.goods(s, d), views.measures(s, d))


QUERIES = {
    "basic_rate": (
        lambda s, d: ops.basic_rate(views.goods(s, d), views.measures(s, d)),
        f"""{views.WITH_MEASURES}, {ANC}, j AS (SELECT *, {BUCKET} = 'basic' AS basic, {RATE} AS rate FROM anc JOIN measures USING (goods_code_10) WHERE applies),
        r AS (SELECT *, row_number() OVER (PARTITION BY code10, basic ORDER BY {NEAR.split(', ')[0]} DESC, length(rtrim(goods_code_10, '0')) DESC, rate, measure_id) AS k FROM j)
        SELECT code10, count(*) AS n_measures, count_if(basic) AS n_basic, max(CASE WHEN basic AND k = 1 THEN duty_text END) AS best_basic FROM r GROUP BY code10""",
    ),
    "inherit_measures": (
        lambda s, d: ops.inheritance_counts(views.goods(s, d), views.measures(s, d)),
        f"""{views.WITH_MEASURES}, {ANC} SELECT code10, CASE WHEN goods_code_10 = code10 THEN 'direct' ELSE 'ancestor' END AS scope, count(*) AS n, min(measure_id) AS first_id, count(DISTINCT legal_base) AS bases
        FROM anc JOIN measures USING (goods_code_10) GROUP BY ALL""",
    ),
    "current_measures": (
        lambda s, d: ops.current_measures(views.measures(s, d)),
        f"{views.WITH_MEASURES} SELECT * FROM measures WHERE applies",
    ),
    "resolve_branches": (
        lambda s, d: _branches(s, d),
        f"""{views.WITH_MEASURES}, {BRANCH} SELECT *, row_number() OVER (PARTITION BY heading ORDER BY leaf DESC, n_measures DESC, goods_code_10) AS place FROM branches""",
    ),
    "primary_branch": (
        lambda s, d: ops.primary_branch(_branches(s, d)),
        f"""{views.WITH_MEASURES}, {BRANCH} SELECT heading, first(goods_code_10 ORDER BY applies DESC, leaf DESC, n_measures DESC, goods_code_10) AS primary_code FROM branches GROUP BY heading""",
    ),
    "branch_status": (
        lambda s, d: ops.branch_status(views.goods(s, d).select(F.concat(F.left("code10", F.lit(3)), F.lit("0")).alias("heading")).unionByName(views.goods(s, d).select(F.concat(F.left("code10", F.lit(3)), F.lit("5")).alias("heading"))), _branches(s, d)),
        f"""{views.WITH_MEASURES}, {BRANCH} SELECT heading, coalesce(count_if(leaf), 0) AS n_leaves, CASE WHEN count(goods_code_10) = 0 THEN 'none' WHEN count_if(leaf) = 0 THEN 'non_declarable_only' WHEN count_if(leaf) = 1 THEN 'one_leaf' ELSE 'several_leaves' END AS status
        FROM (SELECT DISTINCT substr(code10, 1, 3) || t.x AS heading FROM goods, (VALUES ('0'), ('5')) AS t(x)) LEFT JOIN branches USING (heading) GROUP BY heading""",
    ),
    "measure_groups": (
        lambda s, d: ops.measure_groups(views.measures(s, d)),
        f"""{views.WITH_MEASURES} SELECT measure_type_code, legal_base, bool_or(applies) AS applies, count(*) AS n, arg_min(duty_text, measure_id) AS first_duty,
        array_to_string(list_slice(list_sort(list_distinct(list(goods_code_10))), 1, 8), ';') AS codes FROM measures GROUP BY ALL""",
    ),
    "duty_priority": (
        lambda s, d: ops.duty_priority(views.goods(s, d), views.measures(s, d)),
        f"""{views.WITH_MEASURES}, {ANC}, j AS (SELECT *, {BUCKET} AS bucket, {RATE} AS rate, CASE WHEN goods_code_10 = code10 THEN 1 ELSE 0 END AS ex, length(rtrim(goods_code_10, '0')) AS wid FROM anc JOIN measures USING (goods_code_10)),
        u AS (SELECT *, row_number() OVER (PARTITION BY code10, bucket, measure_type_code, duty_text ORDER BY ex DESC, wid DESC, measure_id) AS same FROM j),
        p AS (SELECT *, row_number() OVER (PARTITION BY code10, bucket ORDER BY rate, ex DESC, wid DESC, measure_id) AS place FROM u WHERE same = 1)
        SELECT code10, bucket, place, measure_id, duty_text, rate FROM p WHERE place <= 3""",
    ),
    "parse_duties": (
        lambda s, d: ops.parse_duties(views.measures(s, d)),
        f"""{views.WITH_MEASURES} SELECT DISTINCT duty_text, CASE WHEN duty_text = 'NIHIL' THEN 'nihil' WHEN regexp_full_match(duty_text, '\\d+ %') THEN 'simple_percent' ELSE 'compound_rate' END AS kind,
        TRY_CAST(nullif(regexp_extract(duty_text, '(\\d+) %', 1), '') AS DOUBLE) AS percent, TRY_CAST(nullif(regexp_extract(duty_text, '(\\d+) EUR', 1), '') AS DOUBLE) AS specific FROM measures""",
    ),
    "duty_kinds": (
        lambda s, d: views.measures(s, d).groupBy(duty.duty_kind(F.concat(F.when(F.col("measure_id") % 4 == 0, "").when(F.col("measure_id") % 4 == 1, "Cond: B cert: C-644 (29): ").otherwise(""), "duty_text", F.when(F.col("measure_id") % 4 == 2, " + EA MAX 24.2 EUR/DTN").otherwise(""))).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        f"""{views.WITH_MEASURES} SELECT CASE WHEN measure_id % 4 = 1 THEN 'condition_expression' WHEN measure_id % 4 = 2 THEN 'min_max_rate' WHEN duty_text = 'NIHIL' THEN 'nihil'
        WHEN regexp_full_match(duty_text, '\\d+ %') THEN 'simple_percent' ELSE 'compound_rate' END AS kind, count(*) AS n FROM measures GROUP BY ALL""",
    ),
    "certificate_kinds": (
        lambda s, d: _groups(s, d).groupBy(duty.certificate_kind(F.col("certificate")).alias("kind")).agg(F.count(F.lit(1)).alias("n")),
        f"""{views.WITH_MEASURES}, {GROUPS} SELECT CASE substr(certificate, 1, 1) WHEN 'Y' THEN 'exemption_declaration' WHEN 'C' THEN 'mandatory_certificate' WHEN 'N' THEN 'national_document' WHEN 'u' THEN 'preferential_origin' WHEN 'L' THEN 'import_license' ELSE 'other' END AS kind, count(*) AS n FROM grp GROUP BY ALL""",
    ),
    "scope_join_chapter": (
        lambda s, d: ops.scope_join_chapter(views.goods(s, d), s.createDataFrame(DOCS, "document string, scope string")).select("p_partkey", "chapter", "document"),
        f"""{views.WITH_GOODS}, sc AS (SELECT document, upper(trim(unnest(string_split_regex(scope, '[;,]')))) AS p FROM {values(DOCS, 'document, scope')})
        SELECT DISTINCT p_partkey, substr(code10, 1, 2) AS chapter, document FROM goods JOIN sc ON p = 'ALL' OR (substr(code10, 1, 2) >= substr(p, 1, 2) AND substr(code10, 1, 2) <= right(p, 2))""",
    ),
    "match_requirements": (
        lambda s, d: ops.match_requirements(_groups(s, d), s.createDataFrame(REQS, "requirement string, trigger_certificate string, trigger_measure string, trigger_base string")),
        f"""{views.WITH_MEASURES}, {GROUPS}, q AS (SELECT * FROM {values(REQS, 'requirement, tc, tm, tb')}),
        m AS (SELECT measure_type_code, legal_base, requirement, CASE WHEN tm = '' THEN 2 ELSE 1 END AS rank FROM grp JOIN q ON tc <> '' AND certificate = tc AND (tm = '' OR tm = measure_type_code) AND (tb = '' OR tb = legal_base)
        UNION ALL SELECT measure_type_code, legal_base, requirement, 3 FROM grp JOIN q ON tc = '' AND tm <> '' AND tm = measure_type_code)
        SELECT measure_type_code, legal_base, requirement, min(rank) AS rank FROM m GROUP BY ALL""",
    ),
    "decide_requirements": (_decided, f"WITH {DETAILS} SELECT * FROM decided"),
    "checklist": (
        lambda s, d: ops.checklist(_decided(s, d).withColumn("subject", F.col("subject") % 500)),
        f"""WITH {DETAILS} SELECT subject % 500 AS subject, count_if(status = 'required') AS n_required, count_if(status = 'pending') AS n_pending, count_if(status = 'conditional') AS n_conditional, count_if(status = 'exempted') AS n_exempted,
        arg_min(status, CASE status WHEN 'required' THEN 0 WHEN 'pending' THEN 1 WHEN 'conditional' THEN 2 ELSE 3 END) AS strictest, CAST(sum(n_missing) AS BIGINT) AS n_missing FROM decided GROUP BY 1""",
    ),
    "route_domains": (
        lambda s, d: ops.route_domains(views.goods(s, d), s.createDataFrame(CHAPTERS, "chapter string, domain string"), views.goods(s, d).select(F.element_at(F.split("label", r"\s+"), 1).alias("word")).distinct().withColumn("domain", F.concat(F.lit("word "), F.left("word", F.lit(1))))),
        f"""{views.WITH_GOODS}, kw AS (SELECT DISTINCT string_split_regex(label, '\\s+')[1] AS word FROM goods),
        w AS (SELECT p_partkey, unnest(string_split_regex(label, '\\s+')) AS word FROM goods),
        h AS (SELECT p_partkey, domain FROM goods JOIN {values(CHAPTERS, 'chapter, domain')} ON chapter = substr(code10, 1, 2) UNION SELECT p_partkey, 'word ' || substr(word, 1, 1) FROM w JOIN kw USING (word)),
        g AS (SELECT p_partkey, string_agg(domain, ';' ORDER BY domain) AS d, count(*) AS n FROM h GROUP BY p_partkey)
        SELECT p_partkey, coalesce(d, '') AS domains, coalesce(n, 0) > 1 AS ambiguous, CASE coalesce(n, 0) WHEN 1 THEN 0.8 WHEN 0 THEN 0.2 ELSE 0.5 END::DOUBLE AS confidence FROM goods LEFT JOIN g USING (p_partkey)""",
    ),
    "clean_codes": (
        lambda s, d: views.goods(s, d).select("p_partkey", codes.even_digits(F.substring("code10", 2, 7)).alias("even"), codes.padded10(F.concat(F.left("code10", F.lit(4)), F.lit("."), F.substring("code10", 5, 4))).alias("padded"), codes.goods_code10(F.left("code10", F.lit(8))).alias("ten"), codes.chapter(F.col("code10")).alias("chapter"), codes.number_order(F.substring("code10", 3, 3)).alias("order_key")),
        f"""{views.WITH_GOODS} SELECT p_partkey, '0' || substr(code10, 2, 7) AS even, lpad(substr(code10, 1, 8), 10, '0') AS padded, substr(code10, 1, 8) || '00' AS ten, substr(code10, 1, 2) AS chapter, CAST(substr(code10, 3, 3) AS INT) AS order_key FROM goods""",
    ),
}
