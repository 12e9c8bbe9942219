"""Column expressions for goods codes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def digits(code: Column, limit: int = 8) -> Column:
    """Digits only, cut to limit."""
    return F.substring(F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), r"\D", ""), 1, limit)


def even_digits(code: Column) -> Column:
    """Digits only; an odd number of them gets a zero in front."""
    d = F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), r"\D", "")
    return F.when(F.length(d) % 2 == 1, F.concat(F.lit("0"), d)).otherwise(d)


def padded10(code: Column) -> Column:
    """Seven to nine digits are padded to ten on the left; fewer give an empty text."""
    d = F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), r"\D", "")
    return F.when(F.length(d) >= 10, F.substring(d, 1, 10)).when(F.length(d) >= 7, F.lpad(d, 10, "0")).otherwise(F.lit(""))


def goods_code10(code: Column) -> Column:
    """Eight digits get 00, eleven and twelve are cut to ten; null where the length fits nothing."""
    d = F.regexp_replace(F.coalesce(code.cast("string"), F.lit("")), r"\D", "")
    n = F.length(d)
    return F.when(n == 8, F.concat(d, F.lit("00"))).when(n.between(10, 12), F.substring(d, 1, 10))


def chapter(code: Column) -> Column:
    return F.lpad(digits(code, 2), 2, "0")


def ancestors(code10: Column) -> Column:
    """The code and its broader codes at 8, 6, 4 and 2 digits, distinct, in that order."""
    wider = [F.rpad(F.substring(code10, 1, n), 10, "0") for n in (8, 6, 4, 2)]
    return F.array_distinct(F.array(code10, *wider))


def specificity(code10: Column, target: Column) -> Column:
    """(exact match, length without trailing zeros), to be compared as a struct."""
    return F.struct((code10 == target).cast("int").alias("exact"), F.length(F.rtrim(code10, F.lit("0"))).alias("n"))


def truthy(text: Column) -> Column:
    return F.lower(F.trim(text.cast("string"))).isin("true", "t", "1", "yes", "y")


def number_order(text: Column, otherwise: int = 9999) -> Column:
    """A text sort key as a number where it looks like one."""
    number = F.regexp_extract(F.trim(F.coalesce(text, F.lit(""))), r"^\d{1,9}$", 0)
    return F.when(number != "", number).otherwise(F.lit(str(otherwise))).cast("int")
