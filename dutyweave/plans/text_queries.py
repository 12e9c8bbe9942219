"""Registered queries on label texts, with their SQL twins."""

from __future__ import annotations

from dutyweave.functions import text
from dutyweave.plans import views
from pyspark.sql import functions as F

LABELS = """
SELECT p_partkey, p_name || CASE p_partkey % 6 WHEN 0 THEN 's, whether or not cooked or otherwise prepared' WHEN 1 THEN ' dishes, not stuffed, excluding boxes of heading 4819'
  WHEN 2 THEN 'es containing more than ' || CAST(p_size AS <S>) || ' % of sugar, 5 % or more of cocoa' WHEN 3 THEN ' other than dried fruits or berries' WHEN 4 THEN ', not exceeding 2.5 % glasses' ELSE ' without bones' END AS descr
FROM {part}"""
D_LABELS = f"labels_ AS ({views.for_duckdb(LABELS)})"
D_STEM = """CASE WHEN length(w) > 4 AND suffix(w, 'ies') THEN left(w, -3) || 'y'
  WHEN length(w) > 3 AND suffix(w, 'es') AND NOT suffix(w, 'ses') AND NOT suffix(w, 'oes') THEN CASE WHEN regexp_matches(w, '(ches|shes|xes)$') THEN left(w, -2) ELSE left(w, -1) END
  WHEN length(w) > 3 AND suffix(w, 's') AND NOT suffix(w, 'ss') THEN left(w, -1) ELSE w END"""
D_CLAUSE = "whether\\s+or\\s+not\\s+\\w+(?:\\s+or\\s+(?:otherwise\\s+)?\\w+)*"


def labels(s, d):
    return s.sql(views.for_spark(LABELS), part=views.table(s, d, "part"))


def _residual_text():
    """Wordings on both sides of the test: Other, Otherwise, Other: , a marker at the end, a marker at the beginning."""
    heads = ["Other ", "Otherwise prepared ", " Other, ", "", "N.E.S. ", "not other "]
    head = F.element_at(F.array(*[F.lit(h) for h in heads]), (F.least(F.col("p_partkey") % 7, F.lit(5)) + 1).cast("int"))
    return F.concat(head, "descr", F.when(F.col("p_partkey") % 7 == 3, ", not elsewhere specified").otherwise(""))


def _joined(c):
    return F.array_join(F.array_sort(c), " ")


QUERIES = {
    "label_tokens": (
        lambda s, d: labels(s, d).select("p_partkey", _joined(text.tokens(F.col("descr"))).alias("tokens")),
        f"""WITH {D_LABELS}, w AS (SELECT p_partkey, unnest(regexp_extract_all(regexp_replace(lower(descr), '{D_CLAUSE}', ' ', 'g'), '[a-z0-9]+')) AS w FROM labels_)
        SELECT p_partkey, string_agg(DISTINCT {D_STEM}, ' ' ORDER BY {D_STEM}) AS tokens FROM w WHERE length(w) >= 3 GROUP BY p_partkey""",
    ),
    "negated_tokens": (
        lambda s, d: labels(s, d).select("p_partkey", _joined(text.negated_tokens(F.col("descr"))).alias("negated")),
        f"""WITH {D_LABELS}, c AS (SELECT p_partkey, regexp_replace(regexp_replace(lower(descr), 'whether\\s+or\\s+not', ' ', 'g'), '(?:other\\s+than|excluding|except)[^,;.()]*(?:heading|chapter)\\s*\\d{{2,4}}[^,;.()]*', ' ', 'g') AS t FROM labels_),
        m AS (SELECT p_partkey, unnest(regexp_extract_all(t, '\\b(?:not|no|excluding|without|other\\s+than)\\s+([a-z]+(?:\\s+[a-z]+){{0,2}})', 1)) AS g FROM c),
        w AS (SELECT p_partkey, unnest(regexp_extract_all(g, '[a-z0-9]+')) AS w FROM m), n AS (SELECT p_partkey, string_agg(DISTINCT {D_STEM}, ' ' ORDER BY {D_STEM}) AS n FROM w WHERE length(w) >= 3 GROUP BY p_partkey)
        SELECT p_partkey, coalesce(n, '') AS negated FROM labels_ LEFT JOIN n USING (p_partkey)""",
    ),
    "percent_thresholds": (
        lambda s, d: labels(s, d).select("p_partkey", F.explode(text.thresholds(F.col("descr"))).alias("t")).select("p_partkey", "t.op", "t.value", text.threshold_holds(F.col("t.op"), F.lit(10.0), F.col("t.value")).alias("ten_holds")),
        f"""WITH {D_LABELS}, a AS (SELECT p_partkey, unnest(regexp_extract_all(lower(descr), '(not exceeding|exceeding|more than|less than|at least)\\s*(\\d+(?:\\.\\d+)?)\\s*%', 1)) AS op,
          unnest(regexp_extract_all(lower(descr), '(not exceeding|exceeding|more than|less than|at least)\\s*(\\d+(?:\\.\\d+)?)\\s*%', 2))::DOUBLE AS value FROM labels_
        UNION ALL SELECT p_partkey, unnest(regexp_extract_all(lower(descr), '(\\d+(?:\\.\\d+)?)\\s*%\\s*(or more|or less)', 2)), unnest(regexp_extract_all(lower(descr), '(\\d+(?:\\.\\d+)?)\\s*%\\s*(or more|or less)', 1))::DOUBLE FROM labels_)
        SELECT *, CASE op WHEN 'more than' THEN 10 > value WHEN 'or more' THEN 10 >= value WHEN 'not exceeding' THEN 10 <= value END AS ten_holds FROM a""",
    ),
    "quantity_tokens": (
        lambda s, d: views.measures(s, d).select("measure_id", F.explode(text.quantities(F.col("duty_text"))).alias("q")).groupBy("q.unit", "q.value").agg(F.count(F.lit(1)).alias("n")),
        f"""{views.WITH_MEASURES}, q AS (SELECT unnest(regexp_extract_all(lower(duty_text), '(\\d+(?:\\.\\d+)?)\\s*(kg|g|mg|ml|l|cm|mm|%|eur)(?:\\W|$)', 1)) AS value, unnest(regexp_extract_all(lower(duty_text), '(\\d+(?:\\.\\d+)?)\\s*(kg|g|mg|ml|l|cm|mm|%|eur)(?:\\W|$)', 2)) AS unit FROM measures)
        SELECT unit, value, count(*) AS n FROM q GROUP BY ALL""",
    ),
    "normal_urls": (
        lambda s, d: views.table(s, d, "pages").select("page_id", text.normal_url(F.col("url")).alias("url")),
        "SELECT page_id, lower(regexp_extract(url, '^([A-Za-z]+://[^/?#]*)', 1)) || rtrim(regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1), '/') AS url FROM pages",
    ),
    "residual_labels": (
        lambda s, d: labels(s, d).select("p_partkey", text.is_residual(_residual_text()).alias("residual")),
        f"""WITH {D_LABELS} SELECT p_partkey, CASE p_partkey % 7 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true WHEN 3 THEN false WHEN 4 THEN true ELSE false END AS residual FROM labels_""",
    ),
    "stable_keys": (
        lambda s, d: views.table(s, d, "part").select("p_partkey", text.stable_key(F.col("p_name"), F.col("p_brand"), F.col("p_size")).alias("key")),
        """SELECT p_partkey, sha256('["' || p_name || '","' || p_brand || '","' || CAST(p_size AS VARCHAR) || '"]') AS key FROM part""",
    ),
    "compact_texts": (
        lambda s, d: views.table(s, d, "documents").select("doc_id", F.md5(text.compact(F.col("text"))).alias("compact"), F.length(text.fold_spaces(F.regexp_replace("text", r"[^\x00-\x7F]", ""))).alias("folded")),
        r"""SELECT doc_id, md5(regexp_replace(lower(text), '[^\p{L}\p{N}]+', '', 'g')) AS compact, length(trim(regexp_replace(regexp_replace(text, '[^\x00-\x7F]', '', 'g'), '\s+', ' ', 'g'))) AS folded FROM documents""",
    ),
}
