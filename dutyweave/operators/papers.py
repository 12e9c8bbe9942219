"""Papers of the producer as cells (form, sheet, line, pos, text) to ingredient rows, and the cases to evaluate with."""

from __future__ import annotations

from collections.abc import Callable

from dutyweave.functions.text import fold_spaces
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# fixed values: substance numbers, percents, the headings of composition sheets and how an ingredient line begins
CAS = r"\b(\d{2,7}-\d{2}-\d)\b"
PERCENT = r"(\d{1,3}(?:[.,]\d{1,3})?)\s*%"
SHEET_PERCENT = r"(\d+(?:[.,]\d+)?)\s*%?"
INGREDIENT_LINE = r"(?i)^\s*(전성분|성분|ingredients?)\s*[:：]\s*"
EXAMPLE_SHEET = "예시"
COMPONENT_HEADING, INGREDIENT_HEADING, CONTENT_HEADING, ORIGIN_HEADING = "품명|product name|^구분", "성분|^ingredient$|1차 원재료", "함량|content", "원산지|origin"
CASE_COLUMNS = {"name": ("품목 분류 명칭", "상품명", "product_name"), "url": ("상품 상세", "url"), "code": ("EU HS CODE", "answer")}


def _number(found: Column) -> Column:
    return F.regexp_replace(F.nullif(found, F.lit("")), ",", ".").cast("double")


def coa_entries(cells: DataFrame) -> DataFrame:
    """One row (form, order_index, name, cas, percent) for each line that holds a substance number; the name is its first other cell of three or more characters."""
    bare = F.trim("text")
    is_name = (F.length(bare) >= 3) & ~bare.rlike(f"^{CAS}$")
    lines = cells.groupBy("form", "line").agg(
        F.concat_ws(" | ", F.transform(F.array_sort(F.collect_list(F.when(F.col("text") != "", F.struct("pos", "text")))), lambda c: c["text"])).alias("said"),
        F.min_by(F.when(is_name, bare), F.when(is_name, F.col("pos"))).alias("name"),
    )
    lines = lines.where(F.col("said").rlike(CAS))
    order = F.row_number().over(Window.partitionBy("form").orderBy("line"))
    return lines.select("form", order.alias("order_index"), F.coalesce("name", F.lit("")).alias("name"), F.regexp_extract("said", CAS, 1).alias("cas"), _number(F.regexp_extract("said", PERCENT, 1)).alias("percent"))


def inci_entries(cells: DataFrame) -> DataFrame:
    """Names (form, order_index, name) of the cell with most commas: four at least, more than 70 % ASCII, the first of equals."""
    commas = F.length("text") - F.length(F.regexp_replace("text", ",", ""))
    ascii_share = F.length(F.regexp_replace("text", r"[^\x00-\x7F]", "")) / F.greatest(F.lit(1), F.length("text"))
    fit = cells.withColumn("n", commas).where((F.col("n") >= 4) & (ascii_share > 0.7))
    best = fit.groupBy("form").agg(F.max_by("text", F.struct("n", -F.col("line"), -F.col("pos"))).alias("text"))
    names = best.select("form", F.posexplode(F.split(F.regexp_replace("text", INGREDIENT_LINE, ""), ",")).alias("i", "name"))
    return names.select("form", (F.col("i") + 1).alias("order_index"), F.trim("name").alias("name")).where(F.length("name") >= 2)


def sheet_entries(cells: DataFrame, most: int = 60, heading_lines: int = 120) -> DataFrame:
    """(form, order_index, component, ingredient, percent, origin) of each form's composition table.

    The heading is the first line with a component and an ingredient column, else with an ingredient and a content column. Of a form's
    sheets the one with most lines below its heading counts. Component names hold for the lines below; lines without ingredient go;
    percents of forms that never exceed 1 are shares. The first `most` ingredients stay.
    """
    cells = cells.where(~F.col("sheet").contains(EXAMPLE_SHEET) & F.col("form").isNotNull()).select("form", "sheet", "line", "pos", fold_spaces(F.col("text")).alias("text"))
    low, high = F.lower("text"), F.col("line") <= heading_lines

    def first(pattern: str, name: str) -> Column:
        return F.min(F.when(high & low.rlike(pattern), F.col("pos"))).alias(name)

    # cells are shuffled once, by form; lines, sheets and forms are grouped where they then lie
    lines = cells.repartition("form").groupBy("form", "sheet", "line").agg(
        first(COMPONENT_HEADING, "c_component"), first(INGREDIENT_HEADING, "c_ingredient"), first(CONTENT_HEADING, "c_content"), first(ORIGIN_HEADING, "c_origin"),
        F.collect_list(F.struct("pos", "text")).alias("cells"), F.coalesce(F.bool_or(F.col("text") != ""), F.lit(False)).alias("filled"),
    )
    sheet, form = Window.partitionBy("form", "sheet"), Window.partitionBy("form")
    is_head = F.col("c_ingredient").isNotNull() & (F.col("c_component").isNotNull() | F.col("c_content").isNotNull())
    head = F.struct(F.col("c_component").isNull().alias("second"), F.col("line").alias("head"), "c_component", "c_ingredient", "c_content", "c_origin")
    lines = lines.select("form", "sheet", "line", "cells", "filled", F.min(F.when(is_head, head)).over(sheet).alias("h")).where("line > h.head")
    column = lambda k: F.array_max(F.transform(F.filter("cells", lambda c: c["pos"] == F.col(f"h.c_{k}")), lambda c: c["text"])).alias(k)
    lines = lines.select("form", "sheet", "line", *[column(k) for k in ("component", "ingredient", "content", "origin")], F.count_if("filled").over(sheet).alias("n"))
    lines = lines.withColumn("chosen", F.min(F.when(F.col("n") > 0, F.struct(-F.col("n"), "sheet"))).over(form)["sheet"]).where("sheet = chosen")
    down = form.orderBy("line").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    lines = lines.withColumn("component", F.coalesce(F.last(F.nullif("component", F.lit("")), ignorenulls=True).over(down), F.lit("")))
    rows = lines.where("ingredient <> ''").withColumn("order_index", F.row_number().over(Window.partitionBy("form").orderBy("line"))).where(F.col("order_index") <= most)
    rows = rows.withColumn("percent", _number(F.regexp_extract(F.coalesce("content", F.lit("")), SHEET_PERCENT, 1)))
    shares = F.max("percent").over(Window.partitionBy("form")) <= 1
    return rows.select("form", "order_index", "component", "ingredient", F.when(shares, F.round(F.col("percent") * 100, 2)).otherwise(F.col("percent")).alias("percent"), F.coalesce("origin", F.lit("")).alias("origin"))


#: Reader of each kind of paper.
READERS: dict[str, Callable[[DataFrame], DataFrame]] = {"food": sheet_entries, "chemical": coa_entries, "cosmetics": inci_entries}


def read_papers(cells: DataFrame, readers: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> DataFrame:
    """Ingredient rows of cells with a kind, each kind by its reader; unknown kinds are read as food."""
    readers = READERS if readers is None else readers
    known = F.when(F.col("kind").isin(*readers), F.col("kind")).otherwise("food")
    parts = None
    for kind, reader in readers.items():
        part = reader(cells.where(known == kind)).withColumn("kind", F.lit(kind))
        parts = part if parts is None else parts.unionByName(part, allowMissingColumns=True)
    return parts


def labelled_cases(sheets: DataFrame) -> DataFrame:
    """(name, url, code) of sheets whose headings vary; the code's digits; one row a url and code, lines without either go."""

    def pick(name: str) -> Column:
        have = [F.nullif(F.col(f"`{c}`").cast("string"), F.lit("")) for c in CASE_COLUMNS[name] if c in sheets.columns]
        return F.trim(F.coalesce(*have, F.lit("")))

    rows = sheets.select(pick("name").alias("name"), pick("url").alias("url"), F.regexp_replace(pick("code"), "[^0-9]", "").alias("code"))
    return rows.where("url <> '' AND code <> ''").groupBy("url", "code").agg(F.max("name").alias("name"))


def append_events(events: DataFrame, path: str) -> None:
    """Adds events to the ledger; nothing that stands there is changed."""
    events.write.mode("append").parquet(path)
