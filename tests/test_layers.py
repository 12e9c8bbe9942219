"""Requirements of products by classes, against every product with every requirement."""

from pyspark.sql import functions as F

from dutyweave.operators import layers


def test_domain_classes(spark):
    products = [(i, f"0{i % 2}0{i % 3}1122{i:02d}", ["food", "feed", None][i % 4 % 3]) for i in range(24)]
    reqs = [(1, False, "all", None, ""), (2, True, "ALL ", "", None), (3, True, "all", "", ""), (4, False, "00; 01", None, None), (5, False, "01;00", "", " "), (6, False, None, "0102", "00001122"), (7, False, "", "", None)]
    allowed = [(2, "food"), (3, "feed"), (3, "food"), (2, None)]
    p = spark.createDataFrame(products, "product int, code10 string, domain string")
    r = spark.createDataFrame(reqs, "requirement int, seed boolean, chapters string, headings string, cn8s string")
    a = spark.createDataFrame(allowed, "requirement int, domain string")
    want = set()
    for i, code, domain in products:
        for n, seed, *scopes in reqs:
            parts = {x for s in scopes for x in (s or "").lower().replace(" ", "").split(";")} - {""}
            if parts & {"all", code[:2], code[:4], code[:8]} and (not seed or (domain is not None and (n, domain) in allowed)):
                want.add((i, n))
    found = layers.match_domain_requirements(p, r, a).collect()
    assert len(found) == len(want) and {tuple(x) for x in found} == want
    pairs, of_product, of_requirement = layers.domain_classes(p, r, a)
    assert pairs.count() < len(want) / 2 and of_product.count() == 24 and {(x.requirement, x.of) for x in of_requirement.collect()} == {(1, 1), (2, 2), (3, 3), (4, 4), (5, 4), (6, 6), (7, 7)}
    counts = {x.product: x.n for x in layers.count_domain_requirements(p, r, a).collect()}
    assert counts == {i: sum(x[0] == i for x in want) for i in range(24)}


def test_domain_query_has_every_pair(spark):
    """The query gives every product with every requirement of its codes and domain, not pairs of classes and their members."""
    from dutyweave.plans import layer_queries

    df = layer_queries.QUERIES["match_domain_requirements"][0](spark, "/root/testdata/sf0.001")
    assert df.columns == ["product", "requirement"] and "SELECT * FROM dom" in layer_queries.QUERIES["match_domain_requirements"][1]
    n, distinct, of_all = df.count(), df.distinct().count(), df.where("requirement = 6 AND product % 3 <> 1").count()
    products = layer_queries._products(spark, "/root/testdata/sf0.001")
    assert n == distinct and of_all == products.where("domain <> 'feed'").count() > 0


def test_gates_are_counted_by_class(spark):
    products = spark.createDataFrame([(i, f"0{i % 2}00000000", ["", "food;sanctions", "sanctions;food", None][i % 4]) for i in range(16)], "product int, code10 string, domains string")
    gates = spark.range(300).select(F.col("id").cast("int").alias("gate_id"), F.lit(True).alias("runtime_gate"), F.expr("CASE id % 2 WHEN 0 THEN 'ALL; 00' ELSE '01' END").alias("chapter_scope"), F.expr("CASE id % 3 WHEN 0 THEN 'food' ELSE 'sanctions' END").alias("domain_scope"), F.lit("food").alias("domain"), F.lit("f").alias("family"), F.lit("t").alias("type"), F.lit("a").alias("action"), (-F.col("id")).cast("int").alias("priority"), F.lit("x").alias("title"))
    found = layers.match_pregate(products, gates)
    got = {(r.product, r.domain): (r.gate_id, r.sources) for r in found.collect()}
    for i in range(16):
        for domain in ("food", "sanctions"):
            seen = [g for g in range(300) if (g % 2 == 0 or i % 2 == 1) and (domain == "food") == (g % 3 == 0) and (domain == "sanctions" or i % 4 in (1, 2))]
            assert got.get((i, domain)) == ((max(seen), len(seen)) if seen else None)
    assert "flatten" not in found._jdf.queryExecution().optimizedPlan().toString()  # no list of gates goes to a product
