"""Facts of a product against the questions of a legal axis."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from dutyweave.functions.text import is_residual, stem
from dutyweave.staging import spread

# fixed values: words and prefixes that deny the word after them, entries that stand for no value
NEGATIONS = ("no", "not", "without", "non", "un")
NEGATING_PREFIXES = ("non", "un")
NO_VALUE = ("", "unknown", "none", "null", "n/a")


def words_of(text: Column) -> Column:
    """Stems of the lower-case words of three characters or more."""
    words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    return F.transform(F.filter(words, lambda w: F.length(w) >= 3), stem)


def project_facts(facts: DataFrame, paths: list[str], most: int = 10) -> DataFrame:
    """Rows (product, path, pos, value, flag) of the listed paths that say something: a usable value or a true flag; at most `most` entries a path, by pos, then value."""
    usable = F.coalesce(F.col("flag"), ~F.lower(F.trim(F.coalesce("value", F.lit("")))).isin(*NO_VALUE))
    order = Window.partitionBy("product", "path").orderBy("pos", "value")
    return spread(facts.where(F.col("path").isin(*paths) & usable), "product", "path").withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)


def field_tokens(entries: DataFrame, most: int = 8) -> DataFrame:
    """(product, path, token) of entries (product, path, order_index, value, flag): the first `most` of a list; a true flag answers with its field's words."""
    named = F.filter(F.split(F.element_at(F.split("path", r"\."), -1), "_"), lambda w: ~w.isin("contains", "is", "has", "or", "and"))
    said = F.when(F.col("flag").isNotNull(), F.when(F.col("flag"), named).otherwise(F.slice(named, 1, 0)))
    told = F.when(F.lower(F.trim("value")).isin(*NO_VALUE) | (F.coalesce("order_index", F.lit(0)) > most), F.slice(named, 1, 0)).otherwise(words_of(F.col("value")))
    return entries.select("product", "path", F.explode(F.coalesce(said, told)).alias("token")).distinct()


def facts_for_level(values: DataFrame, level: int, hints: str, most: int = 16) -> DataFrame:
    """Values (product, axis, path, pos, value) as seen at a level: the hint path only at four digits, at most `most` an axis."""
    seen = values if level == 4 else values.where(F.col("path") != hints)
    return seen.withColumn("place", F.row_number().over(Window.partitionBy("product", "axis").orderBy("path", "pos"))).where(F.col("place") <= most)


def project_conditions(conditions: DataFrame, axes: DataFrame, family: tuple[str, ...] = ("product_identity", "species_source", "identity_fallback")) -> DataFrame:
    """Conditions (code, axis, role, value) on their code's primary axis; of the identity family all, as one OR group; qualifiers are dropped."""
    j = conditions.where("role <> 'qualifier'").join(axes.select("code", "primary_axis"), "code")
    both = F.col("axis").isin(*family) & F.col("primary_axis").isin(*family)
    return j.where(both | (F.col("axis") == F.col("primary_axis"))).withColumn("or_group", F.when(both, F.concat("code", F.lit(":primary_axis"))))


def bind_axis(questions: DataFrame, facts: DataFrame, flags: DataFrame, tiers: DataFrame, registers: DataFrame) -> DataFrame:
    """One row for each asked (product, axis): status, tier, lane, tokens, affirmed and denied words.

    questions (product, axis, words), facts (product, path, value), flags (product, path, flag), tiers (axis, tier, lane,
    path), registers (path, word): a path of a register answers only questions that hold one of its words, and then before
    all tiers. Otherwise the first tier with a populated path answers.
    """
    register = registers.groupBy("path").agg(F.array_sort(F.collect_set("word")).alias("register"))
    known = facts.where(~F.lower(F.trim("value")).isin(*NO_VALUE)).groupBy("product", "path").agg(F.flatten(F.collect_list(words_of(F.col("value")))).alias("said"))
    j = questions.join(tiers.join(register, "path", "left"), "axis", "left").join(known, ["product", "path"], "left").join(flags, ["product", "path"], "left")
    asked = F.coalesce(F.arrays_overlap("register", "words"), F.lit(False))
    j = j.withColumn("relevant", F.col("register").isNull() | (F.size("words") == 0) | asked)
    j = j.withColumn("decided", asked & F.col("flag").isNotNull()).withColumn("populated", F.col("relevant") & (F.col("said").isNotNull() | F.col("flag").isNotNull()))
    of_question = Window.partitionBy("product", "axis")
    j = j.withColumn("by_flag", F.max("decided").over(of_question)).withColumn("best", F.min(F.when(F.col("populated"), F.col("tier"))).over(of_question))
    chosen = F.when(F.col("by_flag"), F.col("decided")).otherwise(F.col("populated") & (F.col("tier") == F.col("best")))
    none = F.array().cast("array<string>")
    if_true = lambda cond: F.when(chosen & F.col("register").isNotNull() & cond, F.col("register")).otherwise(none)
    merged = lambda c: F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))), " ")
    said = F.when(chosen & ~F.col("by_flag"), F.coalesce("said", none)).otherwise(none)
    return j.groupBy("product", "axis").agg(
        F.when(F.max("path").isNull(), "unsupported").when(F.max("by_flag") | F.max("best").isNotNull(), "answered").otherwise("empty").alias("status"),
        F.when(F.max("path").isNull(), -1).when(F.max("by_flag"), 0).otherwise(F.coalesce(F.max("best"), F.lit(0))).alias("tier"),
        F.when(F.max("by_flag"), "composition_facts").otherwise(F.coalesce(F.min(F.when(chosen, F.col("lane"))), F.min_by("lane", "tier"), F.lit(""))).alias("lane"),
        merged(F.concat(said, if_true(F.col("flag")))).alias("tokens"),
        merged(if_true(F.col("flag"))).alias("affirmed"),
        merged(if_true(~F.col("flag"))).alias("denied"),
    )


def polarity(text: Column, words: list[str]) -> Column:
    """positive, negated, conflict, neutral or absent: how a text speaks of any of these words.

    Three words back a negation counts, five back "whether or not" takes the word out of the matter.
    """
    all_words = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[a-z0-9]+"), F.lit(0))
    back = lambda i, n: F.slice(all_words, F.greatest(i - n + 1, F.lit(1)), F.least(i, F.lit(n)))  # noqa: E731  words before the 0-based place i

    def kind(w: Column, i: Column) -> Column:
        prefixed = F.lit(False)
        for p in NEGATING_PREFIXES:
            prefixed = prefixed | (w.startswith(p) & stem(F.substring(w, len(p) + 1, 1000)).isin(*words))
        scope = back(i, 5)
        open_scope = F.array_contains(scope, "whether") & F.array_contains(scope, "not") & F.array_contains(scope, "or")
        denied = F.arrays_overlap(back(i, 3), F.array(*[F.lit(n) for n in NEGATIONS]))
        return F.when(stem(w).isin(*words), F.when(open_scope, "neutral").when(denied, "negated").otherwise("positive")).when(prefixed, "negated").otherwise("absent")

    kinds = F.transform(all_words, kind)
    has = lambda k: F.array_contains(kinds, k)
    return F.when(has("positive") & has("negated"), "conflict").when(has("positive"), "positive").when(has("negated"), "negated").when(has("neutral"), "neutral").otherwise("absent")


def polarity_verdicts(rows: DataFrame, words: list[str]) -> DataFrame:
    """Verdict, score and reason of rows (case_id, text, wrapper): source text decides, the wrapper flag alone does not."""
    p = polarity(F.col("text"), words)
    return rows.select(
        "case_id",
        F.when(p == "positive", "true").when(p == "negated", "false").otherwise("unknown").alias("verdict"),
        F.when(p == "positive", 3).when(p == "negated", -100).otherwise(0).alias("score"),
        F.when(p == "positive", "affirmative_source_text").when(p == "negated", "explicit_negation").when(p == "conflict", "polarity_conflict").when(p == "neutral", "neutral_scope_qualifier")
        .when(F.col("wrapper").isNotNull(), "wrapper_requires_text_corroboration").otherwise("no_source_text").alias("reason"),
    )


def axis_verdicts(rows: DataFrame, states: list[str], forms: list[str]) -> DataFrame:
    """O, X, resid or none of rows (row_id, axis, label, status, tokens, denied, first, accessory), the last four arrays of words.

    A denied word of the label is X. State axes compare the label's state words, the form axis its form words only. A match
    with accessory ingredients alone is X on the species and material axes.
    """
    own = words_of(F.col("label"))
    lit = lambda ws: F.array(*[F.lit(w) for w in ws])
    in_states = F.array_intersect(own, lit(states))
    asked = F.when(F.col("axis") == "physical_form", F.array_intersect(own, lit(forms))).otherwise(own)
    matched = F.array_intersect(asked, "tokens")
    side = F.arrays_overlap(matched, "accessory") & ~F.arrays_overlap(matched, "first") & (F.size(F.array_except(matched, "accessory")) == 0)
    state_axis = F.col("axis").isin("preservation_state", "processing_method", "condition_quality", "processing_state")
    return rows.select(
        "row_id",
        F.when(F.trim(F.coalesce("label", F.lit(""))) == "", "none")
        .when(is_residual(F.col("label")), "resid")
        .when(F.arrays_overlap(own, "denied"), "X")
        .when(F.col("status") != "answered", "none")
        .when(state_axis, F.when(F.size(in_states) == 0, "none").when(F.arrays_overlap(in_states, "tokens"), "O").otherwise("X"))
        .when((F.col("axis") == "physical_form") & (F.size(asked) == 0), "none")
        .when(F.size(matched) == 0, "X")
        .when(F.col("axis").isin("species_source", "material_composition") & side, "X")
        .otherwise("O").alias("verdict"),
    )


def resolve_concepts(texts: DataFrame, labels: DataFrame, closed: DataFrame) -> DataFrame:
    """(text, concept): the most specific concepts whose label stands in a text at word boundaries; texts without any are missing.

    Texts are cut into runs of as many words as labels have, so that labels meet them by equality.
    """
    normal = F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"[^a-z0-9]+", " "))
    tidy = labels.select("concept", F.trim(F.regexp_replace(F.lower("label"), r"[^a-z0-9]+", " ")).alias("run"))
    lengths = [r["n"] for r in tidy.select(F.size(F.split("run", " ")).alias("n")).distinct().collect()]  # words of a label: a handful
    w = F.split(normal, " ")

    def runs_of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))
        return F.when(F.size(w) >= n, runs).otherwise(F.array().cast("array<string>"))

    runs = F.flatten(F.array(*[runs_of(n) for n in lengths]))
    found = texts.select("text").distinct().select("text", F.explode(F.array_distinct(runs)).alias("run")).join(tidy, "run").select("text", "concept").distinct()
    below = found.join(closed.where("distance > 0"), "concept").select("text", F.col("ancestor").alias("concept")).distinct()
    return found.join(below, ["text", "concept"], "left_anti")


def answer_concepts(pairs: DataFrame, labels: DataFrame, closed: DataFrame) -> DataFrame:
    """(pair_id, verdict, reason) of pairs (pair_id, question, fact).

    O: equal phrases, or the fact is the question's concept or below it; SILENCE: unresolved, or the fact lies above; X: disjoint.
    """
    named = resolve_concepts(pairs.select(F.col("question").alias("text")).unionByName(pairs.select(F.col("fact").alias("text"))), labels, closed)
    q = pairs.join(named.select(F.col("text").alias("question"), F.col("concept").alias("asked")), "question", "left")
    f = q.join(named.select(F.col("text").alias("fact"), F.col("concept").alias("known")), "fact", "left")
    up = closed.select(F.col("concept").alias("known"), F.col("ancestor").alias("asked"), F.lit(True).alias("at_or_below"))
    down = closed.where("distance > 0").select(F.col("concept").alias("asked"), F.col("ancestor").alias("known"), F.lit(True).alias("above"))
    j = f.join(up, ["known", "asked"], "left").join(down, ["asked", "known"], "left")
    g = j.groupBy("pair_id").agg(*[F.max(c).alias(c) for c in ("at_or_below", "above", "asked", "known", "question", "fact")])
    tidy = lambda c: F.trim(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+", " "))
    equal = (tidy("question") != "") & (tidy("question") == tidy("fact"))
    reason = (
        F.when(equal, "exact_phrase").when(F.col("asked").isNull() | F.col("known").isNull(), "taxonomy_term_unresolved").when(F.col("at_or_below"), "fact_is_question_or_descendant")
        .when(F.col("above"), "fact_is_only_question_ancestor").otherwise("authoritative_taxa_disjoint")
    )
    verdict = F.when(reason.isin("exact_phrase", "fact_is_question_or_descendant"), "O").when(reason == "authoritative_taxa_disjoint", "X").otherwise("SILENCE")
    return g.select("pair_id", verdict.alias("verdict"), reason.alias("reason"))


def merge_families(ranked: DataFrame) -> DataFrame:
    """Places of children (product, parent, parent_score, code, score): by the parent's score, then the place in the own family, then the own score."""
    family = Window.partitionBy("product", "parent").orderBy(F.desc("score"), "code")
    every = Window.partitionBy("product").orderBy(F.desc("parent_score"), "in_family", F.desc("score"), "code")
    return ranked.withColumn("in_family", F.row_number().over(family)).withColumn("place", F.row_number().over(every))


def validate_choices(choices: DataFrame, cards: DataFrame, facts: DataFrame, fields: list[str], most: int = 5) -> DataFrame:
    """Answers (product, pos, chapter, path, field) that hold: chapter among the cards, path populated, field an authority field; each chapter once, the first is selected."""
    ok = choices.where(F.col("field").isin(*fields)).join(cards.select("chapter"), "chapter", "left_semi").join(facts.select("product", "path").distinct(), ["product", "path"], "left_semi")
    first = ok.groupBy("product", "chapter").agg(F.min("pos").alias("pos"))
    order = Window.partitionBy("product").orderBy("pos", "chapter")
    placed = first.withColumn("place", F.row_number().over(order)).where(F.col("place") <= most)
    return placed.select("product", "chapter", "place", F.when(F.col("place") == 1, "selected").otherwise("alternative").alias("role"))


def promote_rows(facts: DataFrame, rows: DataFrame) -> DataFrame:
    """Facts (product, name, value) and the accepted table rows whose compact value the product has no fact of yet."""
    key = F.regexp_replace(F.lower(F.coalesce("value", F.lit(""))), r"\s+", "")
    known = facts.select("product", key.alias("k")).distinct()
    new = rows.where("accepted").withColumn("k", key).where("k <> ''").groupBy("product", "k").agg(F.min_by(F.struct("name", "value"), "pos").alias("r")).join(known, ["product", "k"], "left_anti")
    return facts.select("product", "name", "value", F.lit("fact").alias("origin")).unionByName(new.select("product", "r.name", "r.value", F.lit("table_row").alias("origin")))
