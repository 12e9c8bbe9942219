"""Facts from the lines of a page: a label's line with the lines after it, lines with a quantity, and a page's summary fields."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.functions.text import fold_spaces
from dutyweave.operators.containment import contained
from dutyweave.staging import meet

#: Labels that are looked for in every line.
FEW = 64


def capture_fact_lines(lines: DataFrame, labels: DataFrame, value: str, noise: str, quantity: str, placeholder: str) -> DataFrame:
    """(page_id, pos, label, text) of lines (page_id, pos, line) and labels (label, most); patterns are of lower-case lines.

    A line that holds a label, the longest counts, opens a field; up to `most` of the lines after it that match value and not noise
    belong to it, until the next such line. Other lines of an open field are left out; outside of one, lines with a quantity are
    facts without a label. Placeholder lines are nothing at all. Of equal facts of a page the first stays. FEW labels or less are
    looked for in each line as it is read; of more, lines meet those that they contain.
    """
    l = lines.withColumn("line", fold_spaces(F.col("line"))).where("line <> ''").select("page_id", "pos", "line", F.lower("line").alias("low"))
    few = labels.where("label <> ''").select("label", "most").distinct().limit(FEW + 1).collect()
    if len(few) <= FEW:
        kind = labels.schema["most"].dataType
        known = [F.struct(F.lit(len(r.label)).alias("n"), F.lit(r.label).alias("label"), F.lit(r.most).cast(kind).alias("most")) for r in few]
        known = F.array(*known).cast(f"array<struct<n:int,label:string,most:{kind.simpleString()}>>")
        l = l.withColumn("_l", F.array_max(F.filter(known, lambda x: F.contains(F.col("low"), x["label"]))))
    else:
        held = contained(l.select(F.col("low").alias("text")), labels.select(F.col("label").alias("needle")))
        best = held.join(labels, held["needle"] == labels["label"]).groupBy("text").agg(F.max(F.struct(F.length("label").alias("n"), "label", "most")).alias("_l"))
        l = meet(l, best.withColumnRenamed("text", "low"), "low", "left")
    l = l.withColumn("_blank", F.col("low").rlike(placeholder))
    opens = F.col("_l").isNotNull() & ~F.col("_blank")
    page, field = Window.partitionBy("page_id"), Window.partitionBy("page_id", "_field")
    l = l.withColumn("_field", F.count_if(opens).over(page.orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    l = l.withColumn("_of", F.max(F.when(opens, F.col("_l"))).over(field))
    fits = ~opens & ~F.col("_blank") & F.col("low").rlike(value) & ~F.col("low").rlike(noise)
    l = l.withColumn("_before", F.count_if(fits).over(field.orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)))
    still = F.col("_of").isNotNull() & (F.col("_before") < F.col("_of.most"))
    taken = l.where(opens | fits & still).groupBy("page_id", "_field").agg(F.min("pos").alias("pos"), F.first("_of.label").alias("label"), F.array_sort(F.collect_list(F.struct("pos", "line"))).alias("p"))
    fields = taken.select("page_id", "pos", "label", F.array_join(F.transform("p", lambda x: x["line"]), " ").alias("text"))
    loose = l.where(~opens & ~F.col("_blank") & ~still & F.col("low").rlike(quantity)).select("page_id", "pos", F.lit(None).cast("string").alias("label"), F.col("line").alias("text"))
    each = Window.partitionBy("page_id", "text").orderBy("pos")
    return fields.unionByName(loose).withColumn("_n", F.row_number().over(each)).where("_n = 1").drop("_n")


def summary_fields(lines: DataFrame, labels: DataFrame, headings: str, price: str) -> DataFrame:
    """(page_id, field, value) of lines (page_id, pos, line): the one or two lines after the first line that is a label (label) and has any.

    A label, a line that matches headings, or one that matches price ends the value.
    """
    marked = lines.where("trim(line) <> ''").join(labels.select(F.col("label").alias("line"), F.lit(True).alias("_label")).distinct(), "line", "left")
    stops = F.col("_label").isNotNull() | F.col("line").rlike(headings) | F.col("line").rlike(price)
    w = Window.partitionBy("page_id").orderBy("pos")
    after = marked.withColumn("_stops", stops).withColumn("_next", F.struct("line", "_stops"))
    after = after.withColumn("_1", F.lead("_next", 1).over(w)).withColumn("_2", F.lead("_next", 2).over(w)).where("_label AND _1 IS NOT NULL AND NOT _1._stops")
    value = F.when(F.col("_2").isNull() | F.col("_2._stops"), F.col("_1.line")).otherwise(F.concat_ws(" ", "_1.line", "_2.line"))
    return after.groupBy("page_id", F.col("line").alias("field")).agg(F.min_by(fold_spaces(value), "pos").alias("value"))
