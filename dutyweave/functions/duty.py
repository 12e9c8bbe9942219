"""Column expressions for duty texts and measure kinds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values: units and markers of duty expressions
UNITS = r"KGM(?:\s+S)?|DTN(?:\s+[A-Z])?|TNE|NAR|NPR|MTK|LTR|HLT|GRM"
NUMBER = r"\d[\d.,]*"
# fixed values: certificate categories by first letter
CERTIFICATES = {"Y": "exemption_declaration", "C": "mandatory_certificate", "N": "national_document", "U": "preferential_origin", "L": "import_license"}


def duty_kind(text: Column) -> Column:
    """blank, nihil, condition_expression, simple_percent, min_max_rate, agricultural_component, compound_rate, specific_rate, supplementary_unit, unknown."""
    t = F.trim(F.coalesce(text, F.lit("")))
    u = F.upper(t)
    percent, specific = t.rlike(rf"(^|[^\w.]){NUMBER}\s*%"), u.rlike(rf"(^|[^\w.]){NUMBER}\s*EUR\s*/?\s*({UNITS})\b")
    return (
        F.when(t == "", "blank")
        .when(u == "NIHIL", "nihil")
        .when(u.startswith("COND:"), "condition_expression")
        .when(t.rlike(rf"^\s*{NUMBER}\s*%\s*$"), "simple_percent")
        .when(u.rlike(rf"\b(MIN|MAX)\s+{NUMBER}\s+EUR"), "min_max_rate")
        .when(u.rlike(r"\+\s*(EA|EAR|ADSZR?|ADFM|AC)\b"), "agricultural_component")
        .when(percent & specific, "compound_rate")
        .when(specific, "specific_rate")
        .when(u.rlike(rf"^({UNITS})$"), "supplementary_unit")
        .otherwise("unknown")
    )


def percent_part(text: Column) -> Column:
    found = F.regexp_extract(F.coalesce(text, F.lit("")), r"(\d+(?:[.,]\d+)?)\s*%", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).cast("double"))


def specific_part(text: Column) -> Column:
    found = F.regexp_extract(F.upper(F.coalesce(text, F.lit(""))), r"(\d+(?:[.,]\d+)?)\s*EUR", 1)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit(".")).cast("double"))


def duty_bucket(code: Column, description: Column) -> Column:
    """fta, conditional or basic; the description's quota, suspension and end use come before codes."""
    low = F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(low.rlike("quota|suspension|end-use|end use"), "conditional")
        .when(code.isin("143", "145", "146"), "conditional")
        .when((code == "142") | low.contains("tariff preference"), "fta")
        .when(code.isin("103", "105") | low.contains("third country duty"), "basic")
        .otherwise("conditional")
    )


def certificate_kind(code: Column) -> Column:
    """Certificate category by its first letter."""
    first, kind = F.upper(F.left(F.trim(code), F.lit(1))), F.lit("other")
    for letter, name in CERTIFICATES.items():
        kind = F.when(first == letter, name).otherwise(kind)
    return F.when(F.coalesce(code, F.lit("")) == "", "unknown").otherwise(kind)
