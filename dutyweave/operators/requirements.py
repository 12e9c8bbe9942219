"""Duties, measures and document requirements of goods codes, for many codes at once.

Reference tables join on codes; ancestor lists are exploded so that inheritance is an
equality join, which Spark may broadcast or shuffle by the measured size of a side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.functions import codes, duty


def inherit_measures(targets: DataFrame, measures: DataFrame) -> DataFrame:
    """Every measure of a target's code or of a broader code, with its scope: direct or ancestor."""
    wide = targets.select("code10", F.explode(codes.ancestors(F.col("code10"))).alias("goods_code_10")).distinct()
    joined = wide.join(measures, "goods_code_10")
    return joined.withColumn("scope", F.when(F.col("goods_code_10") == F.col("code10"), "direct").otherwise("ancestor"))


def current_measures(measures: DataFrame) -> DataFrame:
    return measures.where("applies")


def resolve_branches(measures: DataFrame) -> DataFrame:
    """One row a 10-digit code: distinct measure kinds in order of measure_id, any-applies flag, leaf flag, rank among the heading's codes."""
    per_kind = measures.groupBy("goods_code_10", "measure_type_code").agg(F.min("measure_id").alias("first"), F.count(F.lit(1)).alias("n"), F.max("applies").alias("applies"))
    branches = per_kind.groupBy("goods_code_10").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("first", "measure_type_code"))), lambda x: x["measure_type_code"]), ";").alias("kinds"),
        F.sum("n").alias("n_measures"),
        F.max("applies").alias("applies"),
    )
    branches = branches.withColumn("leaf", ~F.col("goods_code_10").endswith("00")).withColumn("heading", F.left("goods_code_10", F.lit(4)))
    order = Window.partitionBy("heading").orderBy(F.desc("leaf"), F.desc("n_measures"), "goods_code_10")
    return branches.withColumn("place", F.row_number().over(order))


def primary_branch(branches: DataFrame) -> DataFrame:
    """The best branch of each heading: applies, leaf, most measures, then smallest code."""
    best = F.max_by(F.col("goods_code_10"), F.struct("applies", "leaf", "n_measures", (-F.col("goods_code_10").cast("long")).alias("c")))
    return branches.groupBy("heading").agg(best.alias("primary_code"))


def branch_status(headings: DataFrame, branches: DataFrame) -> DataFrame:
    """none, non_declarable_only, one_leaf or several_leaves for each asked heading."""
    n = F.count_if("leaf")
    found = branches.groupBy("heading").agg(n.alias("n_leaves"), F.when(n == 0, "non_declarable_only").when(n == 1, "one_leaf").otherwise("several_leaves").alias("status"))
    joined = headings.select("heading").distinct().join(found, "heading", "left")
    return joined.select("heading", F.coalesce("n_leaves", F.lit(0)).alias("n_leaves"), F.coalesce("status", F.lit("none")).alias("status"))


def measure_groups(measures: DataFrame, most: int = 8) -> DataFrame:
    """(measure kind, legal base): any applies, how many, the first duty text, up to `most` codes in order."""
    return measures.groupBy("measure_type_code", "legal_base").agg(
        F.max("applies").alias("applies"),
        F.count(F.lit(1)).alias("n"),
        F.min_by("duty_text", "measure_id").alias("first_duty"),
        F.array_join(F.slice(F.sort_array(F.collect_set("goods_code_10")), 1, most), ";").alias("codes"),
    )


def duty_priority(targets: DataFrame, measures: DataFrame, keep: int = 3) -> DataFrame:
    """Best rates of each code and bucket: same-looking items keep the most specific code, then lowest rate first.

    Only the first `keep` different-looking items of each attached code and bucket can be among the best of a code that
    inherits them: whatever displaces one of these from a more specific code has the same rate and comes before it. So
    measures are reduced where they are attached, and only these few are handed down.
    """
    rows = measures.withColumn("bucket", duty.duty_bucket(F.col("measure_type_code"), F.lit("")))
    rows = rows.groupBy("goods_code_10", "bucket", "measure_type_code", "duty_text").agg(F.min("measure_id").alias("measure_id"))
    rows = rows.withColumn("rate", F.coalesce(duty.percent_part(F.col("duty_text")), F.lit(0.0)))
    first = Window.partitionBy("goods_code_10", "bucket").orderBy("rate", "measure_id")
    rows = inherit_measures(targets, rows.withColumn("place", F.row_number().over(first)).where(F.col("place") <= keep).drop("place"))
    rows = rows.withColumn("near", codes.specificity(F.col("goods_code_10"), F.col("code10")))
    same = Window.partitionBy("code10", "bucket", "measure_type_code", "duty_text").orderBy(F.desc("near"), "measure_id")
    rows = rows.withColumn("same", F.row_number().over(same)).where("same = 1")
    order = Window.partitionBy("code10", "bucket").orderBy("rate", F.desc("near"), "measure_id")
    return rows.withColumn("place", F.row_number().over(order)).where(F.col("place") <= keep).select("code10", "bucket", "place", "measure_id", "duty_text", "rate")


def inheritance_counts(targets: DataFrame, measures: DataFrame) -> DataFrame:
    """For each code and scope: how many measures it has, the first of them, and how many legal bases; counted where they are attached."""
    bases = measures.groupBy("goods_code_10", "legal_base").agg(F.count(F.lit(1)).alias("n"), F.min("measure_id").alias("first_id"))
    return inherit_measures(targets, bases).groupBy("code10", "scope").agg(F.sum("n").alias("n"), F.min("first_id").alias("first_id"), F.countDistinct("legal_base").alias("bases"))


def basic_rate(goods: DataFrame, measures: DataFrame) -> DataFrame:
    """For each code: how many measures it inherits, and its lowest applying basic rate from the most specific code; reduced where measures are attached."""
    rows = current_measures(measures).withColumn("basic", duty.duty_bucket(F.col("measure_type_code"), F.lit("")) == "basic")
    rate = F.coalesce(duty.percent_part(F.col("duty_text")), F.lit(0.0))
    lowest = F.min(F.when(F.col("basic"), F.struct(rate.alias("rate"), F.col("measure_id").alias("id"), "duty_text")))
    attached = rows.groupBy("goods_code_10").agg(F.count(F.lit(1)).alias("n"), F.count_if("basic").alias("nb"), lowest.alias("lowest"))
    held = inherit_measures(goods.select("code10").distinct(), attached)
    near = F.when(F.col("lowest").isNotNull(), codes.specificity(F.col("goods_code_10"), F.col("code10")))
    return held.groupBy("code10").agg(F.sum("n").alias("n_measures"), F.sum("nb").alias("n_basic"), F.max_by(F.col("lowest.duty_text"), near).alias("best_basic"))


def parse_duties(measures: DataFrame) -> DataFrame:
    """Distinct duty texts with their kind and parts."""
    t = F.col("duty_text")
    return measures.select("duty_text").distinct().select(
        "duty_text", duty.duty_kind(t).alias("kind"), duty.percent_part(t).alias("percent"), duty.specific_part(t).alias("specific")
    )


def scope_join_chapter(goods: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose scope text holds the code's chapter: NN, NN-NN (compared as two-digit texts) or ALL; scopes become values, the join an equality."""
    part = documents.select("document", F.explode(F.split("scope", "[;,]")).alias("p")).withColumn("p", F.upper(F.trim("p")))
    low, high = F.regexp_extract("p", r"^(\d{2})", 1), F.regexp_extract("p", r"(\d{2})$", 1)
    every = F.transform(F.sequence(F.lit(1), F.lit(99)), lambda i: F.lpad(i.cast("string"), 2, "0"))
    spread = part.withColumn("chapters", F.when(F.col("p") == "ALL", every).otherwise(F.filter(every, lambda c: (c >= low) & (c <= high))))
    values = spread.select("document", F.explode("chapters").alias("chapter")).distinct()
    return goods.withColumn("chapter", codes.chapter(F.col("code10"))).join(values, "chapter")


def match_requirements(groups: DataFrame, requirements: DataFrame) -> DataFrame:
    """Best reason why a requirement is triggered by a measure group.

    With a certificate, it and every further trigger that is given must match;
    without one only the measure kind counts.
    """
    free = F.coalesce(F.col("trigger_measure"), F.lit("")) == ""
    by_cert = groups.join(requirements.where("trigger_certificate <> ''"), F.col("certificate") == F.col("trigger_certificate"))
    by_cert = by_cert.where((free | (F.col("trigger_measure") == F.col("measure_type_code"))) & ((F.col("trigger_base") == "") | (F.col("trigger_base") == F.col("legal_base"))))
    by_cert = by_cert.withColumn("rank", F.lit(1) + free.cast("int"))
    by_kind = groups.join(requirements.where("trigger_certificate = '' AND trigger_measure <> ''"), F.col("measure_type_code") == F.col("trigger_measure")).withColumn("rank", F.lit(3))
    order = Window.partitionBy("measure_type_code", "legal_base", "requirement").orderBy("rank", "certificate")
    both = by_cert.unionByName(by_kind)
    return both.withColumn("r", F.row_number().over(order)).where("r = 1").select("measure_type_code", "legal_base", "requirement", "rank")


def decide_requirements(details: DataFrame, facts: DataFrame) -> DataFrame:
    """Status of each detail: exempted, pending, conditional or required; details hold ;-lists of required and blocking facts."""
    known = facts.select("subject", "fact").distinct().withColumn("known", F.lit(True))

    def missing(column: str) -> DataFrame:
        each = details.select("subject", "detail", F.explode(F.split(column, ";")).alias("fact")).where("fact <> ''")
        return each.join(known, ["subject", "fact"], "left").groupBy("subject", "detail").agg(F.count_if(F.col("known").isNull()).alias(f"missing_{column}"))

    rows = details.join(missing("required"), ["subject", "detail"], "left").join(missing("blocking"), ["subject", "detail"], "left")
    block, need = F.coalesce("missing_blocking", F.lit(0)), F.coalesce("missing_required", F.lit(0))
    status = (
        F.when(F.col("negative"), "exempted")
        .when(F.col("exemption") & F.col("exemption_applies"), "exempted")
        .when(block > 0, "pending")
        .when(F.col("exemption"), "conditional")
        .when(F.col("external").isin("true", "conditional"), "conditional")
        .when(F.col("level").isin("mandatory", "mandatory_check"), "required")
        .when(need > 0, "conditional")
        .otherwise("required")
    )
    return rows.select("subject", "detail", status.alias("status"), (block + need).alias("n_missing"))


def checklist(decided: DataFrame) -> DataFrame:
    """Counts by status of each subject and its strictest status."""
    rank = F.when(F.col("status") == "required", 0).when(F.col("status") == "pending", 1).when(F.col("status") == "conditional", 2).otherwise(3)
    return decided.groupBy("subject").agg(
        *[F.count_if(F.col("status") == s).alias(f"n_{s}") for s in ("required", "pending", "conditional", "exempted")],
        F.min_by("status", rank).alias("strictest"),
        F.sum("n_missing").alias("n_missing"),
    )


def route_domains(goods: DataFrame, chapter_domains: DataFrame, keyword_domains: DataFrame) -> DataFrame:
    """Domains of each good from its chapter and from words of its label; confidence 0.8 for one, 0.5 for several, 0.2 for none."""
    g = goods.withColumn("chapter", codes.chapter(F.col("code10")))
    words = g.select("p_partkey", F.explode(F.split("label", r"\s+")).alias("word"))
    hits = g.join(chapter_domains, "chapter").select("p_partkey", "domain").union(words.join(keyword_domains, "word").select("p_partkey", "domain")).distinct()
    sets = hits.groupBy("p_partkey").agg(F.sort_array(F.collect_set("domain")).alias("d"))
    n = F.coalesce(F.size("d"), F.lit(0))
    joined = g.select("p_partkey").join(sets, "p_partkey", "left")
    n = F.when(F.col("d").isNull(), 0).otherwise(F.size("d"))
    return joined.select(
        "p_partkey", F.coalesce(F.array_join("d", ";"), F.lit("")).alias("domains"), (n > 1).alias("ambiguous"), F.when(n == 1, 0.8).when(n > 1, 0.5).otherwise(0.2).alias("confidence")
    )


def attach_acts(measures: DataFrame, acts: DataFrame, chunks: DataFrame, clip: int = 200) -> DataFrame:
    """Act of each legal base with its text assembled in chunk order and clipped."""
    texts = chunks.groupBy("act_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk", "text"))), lambda x: x["text"]), " ").alias("act_text"))
    named = acts.join(texts, "act_id", "left")
    return measures.join(named, "legal_base", "left").withColumn("act_text", F.left(F.coalesce("act_text", F.lit("")), F.lit(clip)))


def scope_join_domain(products: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents whose ;-list of domains holds one of the product's, or all."""
    want = documents.select("document", F.explode(F.split("domains", ";")).alias("domain"))
    have = products.select("product", F.explode(F.split("domains", ";")).alias("domain")).where("domain <> ''")
    have = have.unionByName(products.select("product", F.lit("all").alias("domain")))
    return have.join(want, "domain").select("product", "document").distinct()


def match_guidelines(certificates: DataFrame, mapping: DataFrame, excluded: DataFrame) -> DataFrame:
    """First row of each guideline a product's codes lead to, exact codes first, groups reached otherwise left out."""
    j = certificates.join(mapping, F.col("certificate").startswith(F.col("prefix")) & (F.left("certificate", F.lit(1)) == F.left("prefix", F.lit(1))))
    j = j.join(excluded.select("product", "guideline"), ["product", "guideline"], "left_anti")
    order = Window.partitionBy("product", "guideline").orderBy(F.desc(F.col("certificate") == F.col("prefix")), "certificate", "prefix")
    return j.withColumn("r", F.row_number().over(order)).where("r = 1").select("product", "guideline", "certificate", "prefix")


def bind_documents(details: DataFrame, bindings: DataFrame) -> DataFrame:
    """Documents bound to a subject's details, each with its strictest level and its sorted fields."""
    rank = F.when(F.col("level") == "mandatory", 0).when(F.col("level") == "conditional", 1).otherwise(2)
    return details.join(bindings, "detail").groupBy("subject", "document").agg(
        F.min_by("level", rank).alias("level"), F.array_join(F.sort_array(F.collect_set("field")), ";").alias("fields"), F.count(F.lit(1)).alias("n")
    )


def required_documents(groups: DataFrame) -> DataFrame:
    """Each certificate once, with its first measure kind; exemption and preferential kinds left out."""
    kind = duty.certificate_kind(F.col("certificate"))
    return groups.where(~kind.isin("exemption_declaration", "preferential_origin")).groupBy("certificate").agg(F.min("measure_type_code").alias("first_kind"), F.countDistinct("legal_base").alias("bases"))


def signals(packages: DataFrame) -> DataFrame:
    """Reasons to step back: no measures for a code, an ambiguous domain."""
    none = packages.where("n_measures = 0").select("product", F.lit("no_measures").alias("signal"))
    return none.unionByName(packages.where("ambiguous").select("product", F.lit("ambiguous_domain").alias("signal")))


def document_family(name):
    """Family of a document from words of its name, cosmetics first."""
    low = F.lower(name)
    families = [("cosmetics", "cosmetic|cpnp"), ("health", "health|sanitary|veterinary"), ("plant", "plant|phyto"), ("origin", "origin|eur.1"), ("transport", "invoice|packing|lading")]
    out = None
    for family, pattern in families:
        out = F.when(low.rlike(pattern), family) if out is None else out.when(low.rlike(pattern), family)
    return out.otherwise("other")
