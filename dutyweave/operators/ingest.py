"""Loading, versioning and checking reference tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType
from pyspark.sql.window import Window


def load_text_table(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """A CSV file as text columns of a fixed list; missing values become empty texts."""
    schema = StructType([StructField(c, StringType()) for c in columns])
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path).na.fill("")


def load_common_columns(source: DataFrame, target_columns: list[str], aliases: dict[str, str] | None = None) -> DataFrame:
    """Columns that source and target share (after renaming aliases), trimmed, empty texts as null; missing ones as null text."""
    for old, new in (aliases or {}).items():
        if old in source.columns and new not in source.columns:
            source = source.withColumnRenamed(old, new)
    return source.select(*[F.nullif(F.trim(F.col(c).cast("string")), F.lit("")).alias(c) if c in source.columns else F.lit(None).cast("string").alias(c) for c in target_columns])


def load_substance_lists(lists: dict[str, DataFrame]) -> DataFrame:
    """(list_name, name, cas, detail) of several lists: one row for each CAS number in a cell; further columns fold into detail."""
    parts = []
    for name, df in lists.items():
        extra = [c for c in df.columns if c not in ("name", "cas")]
        cas = F.regexp_extract_all(F.coalesce("cas", F.lit("")), F.lit(r"(\d{2,7}-\d{2}-\d)"), F.lit(1))
        detail = F.concat_ws("; ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in extra]) if extra else F.lit("")
        parts.append(df.select(F.lit(name).alias("list_name"), F.trim("name").alias("name"), F.explode_outer(cas).alias("cas"), detail.alias("detail")))
    found = parts[0]
    for p in parts[1:]:
        found = found.unionByName(p)
    return found.where("coalesce(name, '') <> '' OR cas IS NOT NULL")


def insert_absent(target: DataFrame, incoming: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """target with the incoming rows whose key it lacks; of incoming rows with one key the first stays."""
    first = incoming.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_r = 1").drop("_r")
    return target.unionByName(first.join(target.select(*keys), keys, "left_anti"))


def merge_scope(target: DataFrame, additions: DataFrame, key: str, separator: str = "/") -> DataFrame:
    """Sorted distinct union of the current and added values of a list-valued scope."""
    added = additions.groupBy(key).agg(F.flatten(F.collect_list(F.split("scope", separator))).alias("_more"))
    j = target.join(added, key, "left")
    both = F.array_union(F.split("scope", separator), F.coalesce("_more", F.array().cast("array<string>")))
    return j.withColumn("scope", F.array_join(F.array_sort(F.filter(both, lambda x: x != "")), separator)).drop("_more")


def run_checks(df: DataFrame, checks: dict[str, tuple[Column, int]]) -> DataFrame:
    """(name, ok, detail) of conditional counts, all in one pass."""
    counted = df.agg(*[F.count_if(c).alias(f"c{i}") for i, (c, _) in enumerate(checks.values())])
    rows = F.array(*[F.struct(F.lit(n).alias("name"), (F.col(f"c{i}") == e).alias("ok"), F.concat(F.col(f"c{i}").cast("string"), F.lit(f" of {e}")).alias("detail")) for i, (n, (_, e)) in enumerate(checks.items())])
    return counted.select(F.explode(rows).alias("r")).select("r.*")


def publish_asset(history: DataFrame, incoming: DataFrame) -> DataFrame:
    """History after publishing: incoming (asset, version, payload, updated_at) replace their version and alone are active."""
    new = incoming.withColumn("source_hash", F.sha2("payload", 256)).withColumn("is_active", F.lit(True))
    old = history.join(incoming.select("asset", "version"), ["asset", "version"], "left_anti")
    named = incoming.select("asset", F.lit(True).alias("_named")).distinct()
    old = old.join(named, "asset", "left").withColumn("is_active", F.col("is_active") & F.col("_named").isNull()).drop("_named")
    return old.unionByName(new)


def active_asset(history: DataFrame) -> DataFrame:
    return history.where("is_active").groupBy("asset").agg(F.max_by("payload", F.struct("updated_at", "version")).alias("payload"), F.max("updated_at").alias("updated_at"))


def upsert(target: DataFrame, incoming: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Last write wins: incoming rows before target rows, later `order` first."""
    both = target.withColumn("_p", F.lit(1)).unionByName(incoming.withColumn("_p", F.lit(0)))
    r = F.row_number().over(Window.partitionBy(*keys).orderBy("_p", F.desc(order)))
    return both.withColumn("_r", r).where("_r = 1").drop("_r", "_p")


def code_gap(a: DataFrame, b: DataFrame, most: int = 20) -> DataFrame:
    """Codes of a that b lacks: how many, and the first ones."""
    gone = a.select("code").distinct().join(b.select("code").distinct(), "code", "left_anti")
    first = gone.orderBy("code").limit(most).agg(F.array_join(F.sort_array(F.collect_list("code")), ";").alias("first"))
    return gone.agg(F.count(F.lit(1)).alias("n")).select("n", first.scalar().alias("first"))


def build_name_dictionary(names: DataFrame, generic: list[str]) -> DataFrame:
    """First row in source order of each (ko, en, hs6), generic names dropped."""
    n = names.select(F.trim("ko").alias("ko"), F.lower(F.trim("en")).alias("en"), F.left("code10", F.lit(6)).alias("hs6"), "code10", "pos")
    n = n.where((F.col("ko") != "") & ~F.col("en").isin(*generic) & ~F.col("en").startswith("other"))
    return n.groupBy("ko", "en", "hs6").agg(F.min_by("code10", "pos").alias("code10"), F.min("pos").alias("pos"))


def screen_substances(entries: DataFrame, lists: DataFrame) -> DataFrame:
    """Entries found on a list by CAS number, else by normalised name."""
    by_cas = entries.join(lists.where("cas IS NOT NULL").select("cas", "list_name").distinct(), "cas").select("entry_id", "list_name", F.lit("cas").alias("how"))
    rest = entries.join(by_cas.select("entry_id").distinct(), "entry_id", "left_anti")
    key = F.regexp_replace(F.lower("name"), r"[^a-z0-9]+", "")
    by_name = rest.withColumn("k", key).join(lists.select(key.alias("k"), "list_name").where("k <> ''").distinct(), "k")
    return by_cas.unionByName(by_name.select("entry_id", "list_name", F.lit("name").alias("how")))


def load_forms(forms: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Header table, and one row a product and form of ;-lists, links to unknown forms dropped."""
    heads = forms.dropDuplicates(["form"])
    each = links.select("product", F.explode(F.split("forms", ";")).alias("form")).withColumn("form", F.trim("form")).where("form <> ''")
    return heads, each.join(heads, "form", "left_semi").dropDuplicates(["product", "form"])


def route_documents(files: DataFrame) -> DataFrame:
    """Kind of each file by words of its name, food by default; kinds without a parser pass as stubs."""
    low = F.lower("name")
    kind = F.when(low.rlike("coa|certificate"), "certificate").when(low.rlike("inci|cosmetic"), "cosmetics").when(low.rlike("msds|sds"), "safety").otherwise("food")
    return files.withColumn("kind", kind).withColumn("status", F.when(F.col("kind") == "safety", "stub").otherwise("parsed"))


def explode_runs(runs: DataFrame) -> DataFrame:
    """Nested run documents (JSON text) to one row a stage, candidate and detail."""
    schema = "struct<stages:array<struct<level:int,candidates:array<struct<code:string,details:array<struct<axis:string,verdict:string>>>>>>>"
    s = runs.select("run", F.explode_outer(F.from_json("payload", schema)["stages"]).alias("s"))
    c = s.select("run", F.col("s.level").alias("level"), F.explode_outer("s.candidates").alias("c"))
    return c.select("run", "level", F.col("c.code").alias("code"), F.explode_outer("c.details").alias("d")).select("run", "level", "code", "d.axis", "d.verdict")


def flatten_package_documents(packages: DataFrame, fallback: DataFrame) -> DataFrame:
    """Document list of each package: exempted ones skipped, unique keys by suffix, measure names where nothing is left."""
    d = packages.where("status <> 'exempted'").withColumn("key", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-"))
    r = F.row_number().over(Window.partitionBy("package", "key").orderBy("pos"))
    d = d.withColumn("r", r).withColumn("key", F.when(F.col("r") > 1, F.concat("key", F.lit("_"), F.col("r").cast("string"))).otherwise(F.col("key")))
    rest = fallback.join(d.select("package").distinct(), "package", "left_anti")
    return d.select("package", "key", "name").unionByName(rest.select("package", F.regexp_replace(F.lower("name"), "[^a-z0-9]+", "-").alias("key"), "name"))
