"""Registered queries on the lines of documents, with their SQL twins."""

from __future__ import annotations

from dutyweave.operators import fact_lines as ops
from dutyweave.plans import views
from pyspark.sql import functions as F

LABELS = [("en", 1), ("ou", 2), ("ment", 3), ("sch", 2), ("ing", 1)]
VALUE, NOISE, QUANTITY, PLACEHOLDER = "[aeiou]", "x", "[0-9]", "%%%|###"


def _lines(s, d):
    return views.table(s, d, "documents").select(F.col("doc_id").alias("page_id"), F.posexplode(F.split("text", r"\n")).alias("pos", "line"))


def _labels(s):
    return s.createDataFrame(LABELS, "label string, most int")


def _words(s, d):
    """The words of the benchmark's texts as lines."""
    return views.table(s, d, "benchmark").select(F.col("item_id").alias("page_id"), F.posexplode(F.split(F.lower("text"), "[^a-z]+")).alias("pos", "line"))


D_LINES = "l0 AS (SELECT doc_id AS page_id, k - 1 AS pos, trim(regexp_replace(ls[k], '\\s+', ' ', 'g')) AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL))), l AS (SELECT *, lower(line) AS low FROM l0 WHERE line <> '')"
QUERIES = {
    "capture_fact_lines": (
        lambda s, d: ops.capture_fact_lines(_lines(s, d), _labels(s), VALUE, NOISE, QUANTITY, PLACEHOLDER),
        f"""WITH {D_LINES}, lab(label, most) AS (VALUES {", ".join(f"('{x}', {n})" for x, n in LABELS)}),
        b AS (SELECT page_id, pos, line, low, regexp_matches(low, '{PLACEHOLDER}') AS blank, (SELECT arg_max({{'label': label, 'most': most}}, (length(label), label)) FROM lab WHERE contains(low, label)) AS own FROM l),
        o AS (SELECT *, own IS NOT NULL AND NOT blank AS opens FROM b), f AS (SELECT *, count_if(opens) OVER (PARTITION BY page_id ORDER BY pos) AS fld FROM o),
        g AS (SELECT *, first_value(CASE WHEN opens THEN own END IGNORE NULLS) OVER (PARTITION BY page_id, fld ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS head, NOT opens AND NOT blank AND regexp_matches(low, '{VALUE}') AND NOT regexp_matches(low, '{NOISE}') AS fits FROM f),
        h AS (SELECT *, head IS NOT NULL AND coalesce(count_if(fits) OVER (PARTITION BY page_id, fld ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < head.most AS still FROM g),
        z AS (SELECT page_id, min(pos) AS pos, min(head.label) AS label, string_agg(line, ' ' ORDER BY pos) AS text FROM h WHERE opens OR (fits AND still) GROUP BY page_id, fld
          UNION ALL SELECT page_id, pos, NULL, line FROM h WHERE NOT opens AND NOT blank AND NOT coalesce(still, false) AND regexp_matches(low, '{QUANTITY}'))
        SELECT page_id, pos, label, text FROM z QUALIFY row_number() OVER (PARTITION BY page_id, text ORDER BY pos) = 1""",
    ),
    "summary_fields": (
        lambda s, d: ops.summary_fields(_words(s, d), _words(s, d).where("length(line) = 5").select(F.col("line").alias("label")), "^[m-r]", "e$"),
        """WITH w AS (SELECT item_id AS page_id, unnest(range(0, 100000)[:len(ws)]) AS pos, unnest(ws) AS line FROM (SELECT item_id, string_split_regex(lower(text), '[^a-z]+') AS ws FROM benchmark)), n AS (SELECT * FROM w WHERE line <> ''),
        s AS (SELECT *, length(line) = 5 AS lab, length(line) = 5 OR regexp_matches(line, '^[m-r]') OR suffix(line, 'e') AS stops FROM n),
        a AS (SELECT *, lead(line) OVER v AS l1, lead(stops) OVER v AS s1, lead(line, 2) OVER v AS l2, lead(stops, 2) OVER v AS s2 FROM s WINDOW v AS (PARTITION BY page_id ORDER BY pos))
        SELECT page_id, line AS field, arg_min(CASE WHEN coalesce(s2, true) THEN l1 ELSE l1 || ' ' || l2 END, pos) AS value FROM a WHERE lab AND NOT s1 GROUP BY page_id, line""",
    ),
}
