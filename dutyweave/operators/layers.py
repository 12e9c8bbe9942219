"""Layers of requirements besides the measures: by product domain, before screening, and their union."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dutyweave.functions import codes
from dutyweave.operators.classes import representatives, to_members
from dutyweave.staging import meet, spread, stage

#: Parts in which a class of requirements meets its products.
PARTS = 32


def _parts(scope: Column) -> Column:
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(scope, F.lit(""))), " ", ""), ";"), lambda p: p != "")


def domain_classes(products: DataFrame, requirements: DataFrame, allowed: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pairs (product, requirement) of representatives, members (product, of), members (requirement, of)).

    products (product, code10, domain) meet requirements by chapter, heading, eight digits or "all" in any of three scope columns;
    seeds also need the product's domain among those allowed (requirement, domain). Scopes become values, so the join is an equality.
    Products of equal eight digits and domain are a class, and requirements of equal scopes, seed and allowed domains: a product
    has the requirements of all classes that its representative is paired with. So pairs do not grow with products times requirements.
    """
    scope = F.array_sort(F.array_distinct(F.concat(*[_parts(F.col(c)) for c in ("chapters", "headings", "cn8s")])))
    may = allowed.where("domain IS NOT NULL").groupBy("requirement").agg(F.array_sort(F.collect_set("domain")).alias("may"))
    may = requirements.select("requirement", "seed", scope.alias("scopes")).join(may, "requirement", "left")
    may = may.withColumn("may", F.when(F.col("seed"), F.coalesce("may", F.array().cast("array<string>"))))
    asked, of_product = representatives(products.select("product", F.left("code10", F.lit(8)).alias("cn8"), "domain").distinct(), "product")
    needed, of_requirement = representatives(may.distinct(), "requirement")
    keys = F.array(F.lit("all"), *[F.left("cn8", F.lit(n)) for n in (2, 4, 8)])
    hit = asked.select("product", "domain", F.explode(keys).alias("scope")).join(needed.select("requirement", "seed", "may", F.explode("scopes").alias("scope")), "scope")
    pairs = hit.where("NOT seed OR array_contains(may, domain)").select("product", "requirement").distinct()
    return stage(pairs, "domain-pairs"), of_product, of_requirement


def match_domain_requirements(products: DataFrame, requirements: DataFrame, allowed: DataFrame) -> DataFrame:
    """(product, requirement): every product with every requirement of domain_classes; grows with both.

    A class of requirements meets its products in so many parts, each with all of the class, since a few classes have most products.
    """
    pairs, of_product, of_requirement = domain_classes(products, requirements, allowed)
    met = to_members(pairs, of_product, "product").withColumnRenamed("requirement", "of").withColumn("_part", F.pmod(F.hash("product"), F.lit(PARTS)))
    needed = of_requirement.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1))))
    return meet(spread(met, "of", "_part"), spread(needed, "of", "_part"), ["of", "_part"]).select("product", "requirement")


def count_domain_requirements(products: DataFrame, requirements: DataFrame, allowed: DataFrame) -> DataFrame:
    """(product, n) of products that have requirements of their domain; counted by class."""
    pairs, of_product, of_requirement = domain_classes(products, requirements, allowed)
    sizes = of_requirement.groupBy(F.col("of").alias("requirement")).agg(F.count(F.lit(1)).alias("n"))
    return to_members(pairs.join(sizes, "requirement").groupBy("product").agg(F.sum("n").alias("n")), of_product, "product")


def match_pregate(products: DataFrame, gates: DataFrame, default: str = "sanctions") -> DataFrame:
    """One row for each (product, domain, family, type, action) of the gates that are on, by chapter or ALL: its first gate and how many there are.

    Products name their domains (separated by ;), the default where they name none. Gates are combined once for each class of
    products, those of equal chapters and domains, so what is handed down does not grow with the gates.
    """
    on = gates.where("runtime_gate").withColumn("of", F.coalesce(F.nullif("domain_scope", F.lit("")), F.nullif("domain", F.lit("")), F.lit("")))
    on = on.withColumn("asked", F.explode(F.array_distinct(F.array_compact(F.array(F.nullif("domain_scope", F.lit("")), F.nullif("domain", F.lit("")))))))
    on = on.withColumn("chapter", F.explode(F.array_distinct(F.split(F.upper(F.regexp_replace("chapter_scope", " ", "")), ";"))))
    domains = F.when(F.trim(F.coalesce("domains", F.lit(""))) == "", F.array(F.lit(default))).otherwise(_parts(F.col("domains")))
    asked = products.select("product", codes.chapter(F.col("code10")).alias("own"), F.explode(domains).alias("asked"))
    asked, members = representatives(asked.select("product", "asked", F.explode(F.array(F.col("own"), F.lit("ALL"))).alias("chapter")).distinct(), "product")
    by = ["product", F.col("of").alias("domain"), "family", "type", "action"]
    # a gate is met by way of several chapters and domains, and counts once
    once = asked.join(on, ["chapter", "asked"]).groupBy(*by, "gate_id").agg(F.min(F.struct("priority", "title", "gate_id")).alias("first"))
    g = once.groupBy("product", "domain", "family", "type", "action").agg(F.min("first").alias("first"), F.count("gate_id").cast("int").alias("sources"))
    return to_members(g, members, "product").select("product", "domain", "family", "type", "action", F.col("first.gate_id").alias("gate_id"), "sources")


def all_requirements(layers: dict[str, DataFrame]) -> DataFrame:
    """Rows of all layers with the layer's name; columns that a layer lacks are null."""
    found = None
    for name, rows in layers.items():
        part = rows.withColumn("layer", F.lit(name))
        found = part if found is None else found.unionByName(part, allowMissingColumns=True)
    return found


def rate_rows(duties: DataFrame, measures: DataFrame, tariff_types: list[str]) -> DataFrame:
    """Duty rows (master_id, is_fallback, is_rate_option, rate) that state a rate: no fallbacks, tariff measures only, rate options, neither blank nor a bare condition."""
    rate = F.trim(F.coalesce("rate", F.lit("")))
    kept = duties.where(~F.coalesce("is_fallback", F.lit(False)) & F.coalesce("is_rate_option", F.lit(True)) & (rate != "") & ~F.lower(rate).startswith("cond:"))
    return kept.join(measures.where(F.col("measure_type_code").isin(*tariff_types)).select(F.col("measure_id").alias("master_id")), "master_id", "left_semi")
