"""Column expressions for label texts: stems, tokens, negation, thresholds, quantities, urls, keys."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: the grammar of nomenclature wording
WHETHER = r"whether\s+or\s+not"
WHETHER_CLAUSE = r"whether\s+or\s+not\s+\w+(?:\s+or\s+(?:otherwise\s+)?\w+)*"
CROSS_REFERENCE = r"(?:other\s+than|excluding|except)[^,;.()]*(?:heading|chapter)\s*\d{2,4}[^,;.()]*"
NEGATION = r"\b(?:not|no|excluding|without|other\s+than)\s+([a-z]+(?:\s+[a-z]+){0,2})"
PERCENT_BEFORE = r"(not exceeding|exceeding|more than|less than|at least)\s*(\d+(?:\.\d+)?)\s*%"
PERCENT_AFTER = r"(\d+(?:\.\d+)?)\s*%\s*(or more|or less)"


def stem(token: Column) -> Column:
    """Plural to singular."""
    n = F.length(token)
    return (
        F.when((n > 4) & token.endswith("ies"), F.concat(F.left(token, n - 3), F.lit("y")))
        .when(
            (n > 3) & token.endswith("es") & ~token.endswith("ses") & ~token.endswith("oes"),
            F.when(token.rlike("(ches|shes|xes)$"), F.left(token, n - 2)).otherwise(F.left(token, n - 1)),
        )
        .when((n > 3) & token.endswith("s") & ~token.endswith("ss"), F.left(token, n - 1))
        .otherwise(token)
    )


def tokens(text: Column, pattern: str = "[a-z0-9]+") -> Column:
    """Distinct stems of the words of three or more characters, conditional clauses left out."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WHETHER_CLAUSE, " ")
    words = F.filter(F.regexp_extract_all(cleaned, F.lit(pattern), F.lit(0)), lambda w: F.length(w) >= 3)
    return F.array_distinct(F.transform(words, stem))


def negated_tokens(text: Column) -> Column:
    """Stems that a label negates; "whether or not" and references to other headings do not negate."""
    cleaned = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), WHETHER, " ")
    cleaned = F.regexp_replace(cleaned, CROSS_REFERENCE, " ")
    return F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(cleaned, F.lit(NEGATION), F.lit(1)), lambda m: tokens(m))))


def thresholds(text: Column) -> Column:
    """array<struct<op, value>> of percent thresholds, number after the operator first."""
    low = F.lower(F.coalesce(text, F.lit("")))

    def pairs(pattern: str, op: int, value: int) -> Column:
        ops = F.regexp_extract_all(low, F.lit(pattern), F.lit(op))
        values = F.regexp_extract_all(low, F.lit(pattern), F.lit(value))
        return F.transform(F.arrays_zip(ops.alias("op"), values.alias("value")), lambda x: F.struct(x["op"].alias("op"), x["value"].cast("double").alias("value")))

    return F.concat(pairs(PERCENT_BEFORE, 1, 2), pairs(PERCENT_AFTER, 2, 1))


def threshold_holds(op: Column, percent: Column, value: Column) -> Column:
    return (
        F.when(op.isin("exceeding", "more than"), percent > value)
        .when(op.isin("at least", "or more"), percent >= value)
        .when(op == "less than", percent < value)
        .when(op.isin("not exceeding", "or less"), percent <= value)
    )


def quantities(text: Column) -> Column:
    """array<struct<value, unit>> of numbers with a unit."""
    pattern = r"(\d+(?:\.\d+)?)\s*(kg|g|mg|ml|l|cm|mm|%|eur)(?:\W|$)"
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.arrays_zip(
        F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("value"), F.regexp_extract_all(low, F.lit(pattern), F.lit(2)).alias("unit")
    )


def compact(text: Column) -> Column:
    """Lower case without anything but letters and digits."""
    return F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", "")


def fold_spaces(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))


def normal_url(url: Column) -> Column:
    """Lower-case scheme and host, no query or fragment, no trailing slash."""
    head = F.lower(F.regexp_extract(url, r"^([A-Za-z]+://[^/?#]*)", 1))
    return F.concat(head, F.rtrim(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), F.lit("/")))


# fixed values: how a label of what is left over begins, besides the word "other"
LEFT_OVER = ("not elsewhere specified", "not elsewhere included", "n.e.s")


def is_residual(label: Column) -> Column:
    """A label that names what is left over: the word "other" or a marker of LEFT_OVER at its beginning."""
    found = F.lower(F.trim(F.coalesce(label, F.lit("")))).rlike(r"^other\b")
    for marker in LEFT_OVER:
        found = found | F.lower(F.trim(F.coalesce(label, F.lit("")))).startswith(marker)
    return found


def stable_key(*parts: Column) -> Column:
    """SHA-256 of the parts as one JSON array."""
    return F.sha2(F.to_json(F.array(*[p.cast("string") for p in parts])), 256)
