import pytest
from pyspark.sql import functions as F

from millrace.operators import matching, medallion, planner, quality, runs
from millrace.operators.tables import ConcurrentCommit, LakeTable

PRODUCT = "barcode string, product_name string, brands string, categories_tags string, quantity string, lang string, last_modified_t long, taxonomy_key string, ingested_at string"


def products(spark):
    rows = [
        ("1", "Milk", "B", "", "1 l", "en", 10, "milk", "a"), ("1", "Milk new", "B", "", "1 l", "en", 20, "milk", "a"), ("1", "", "B", "", "1 l", "en", 30, "milk", "a"),
        (" 2", "Rice", None, "", None, None, 10, "rice", "a"), ("2", "Rice two", None, "", None, "", 10, "rice", "b"), ("", "Nameless", None, "", None, "en", 1, "rice", "a"),
        ("3", "Lait", None, "", None, "fr", 1, "milk", "a"), ("4", "Caffè", None, "", None, "en", 1, "coffee", "a"), ("5", "Thing", None, "", None, "en", 1, "nothing", "a"),
    ]
    return spark.createDataFrame(rows, PRODUCT)


def test_dim_product(spark):
    got = {r.barcode: r for r in medallion.dim_product(products(spark), medallion.category_map(spark)).collect()}
    assert set(got) == {"1", "2"}
    assert got["1"].product_name == "Milk new" and got["1"].size_value == 1000.0 and got["2"].product_name == "Rice two"
    strict = medallion.dim_product(products(spark), medallion.category_map(spark), strict_latest=True)
    assert {r.barcode for r in strict.collect()} == {"2"}


def test_cheapest_puts_null_prices_last(spark):
    rows = [("a", "A", "p", "P", "c", None, True), ("b", "B", "p", "P", "c", 2.0, True), ("c", "C", "p", "P", "c", 1.0, False)]
    offers = spark.createDataFrame(rows, "store_id string, store_name string, product_id string, product_name string, category string, price double, in_stock boolean")
    assert medallion.cheapest_products(offers).first().cheapest_store == "B"
    assert medallion.category_price_stats(offers).first().cheapest_store == "B"


def test_checks_quarantine_and_drift(spark):
    raw = products(spark)
    dim = medallion.dim_product(raw, medallion.category_map(spark))
    offers = spark.createDataFrame([(1.0,), (None,), (1000.01,)], "price double")
    got = {r.check_name: r for r in quality.run_checks(raw, dim, offers, "r", "now").collect()}
    assert got["malformed_records"].failed_count == 2 and got["duplicate_products"].passed and got["invalid_prices"].failed_count == 2
    assert quality.hard_failures(quality.run_checks(raw, dim, offers, "r", "now")).first().n == 1
    assert quality.quarantine(raw, "r", "now").count() == 2


def test_empty_inputs(spark):
    empty = spark.createDataFrame([], PRODUCT)
    dim = medallion.dim_product(empty, medallion.category_map(spark))
    assert dim.count() == 0
    assert quality.run_checks(empty, dim, spark.createDataFrame([], "price double"), "r", "n").where("failed_count = 0").count() == 5
    assert runs.watermarks(empty, "s", "n").count() == 0


def test_watermarks_are_strict(spark):
    raw = products(spark)
    marks = runs.watermarks(raw, "s", "n")
    assert runs.since(raw, marks).count() == 0
    assert runs.since(raw, marks.where("category <> 'milk'")).count() == 4


def test_table_versions(spark, tmp_path):
    lake = LakeTable(spark, f"file://{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string, p string")
    assert not lake.exists()
    lake.write(rows((1, "a", "x"), (2, "b", "y")), "overwrite", ["p"])
    lake.upsert(rows((2, "c", "y"), (2, "d", "y"), (3, "e", "z")), "k")
    lake.upsert(rows((2, "c", "y"), (2, "d", "y"), (3, "e", "z")), "k")
    read = lambda df: sorted(tuple(r) for r in df.select("k", "v", "p").collect())
    assert read(lake.read()) == [(1, "a", "x"), (2, "d", "y"), (3, "e", "z")]
    assert read(lake.read(0)) == [(1, "a", "x"), (2, "b", "y")]
    lake.insert_new(rows((3, "no", "z"), (4, "f", "z"), (None, "g", "z")), "k")
    for k in range(5, 9):
        lake.write(rows((k, "h", "z")), "append")
    before = read(lake.read())
    assert lake.compact()["after"] == 3 and read(lake.read()) == before and len(before) == 8
    lake.zorder(["k"], files=2)
    assert read(lake.read()) == before and lake.version() == 9
    with pytest.raises(ConcurrentCommit):
        lake._commit([], [], lake.read().schema, 3)
    with pytest.raises(ValueError):
        lake.read(99)


def test_upsert_guard_and_new_columns(spark, tmp_path):
    lake = LakeTable(spark, f"file://{tmp_path}/t")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, t long")
    lake.upsert(rows((1, 10), (2, 10)), "k", newer="t")
    lake.upsert(rows((1, 5), (2, 20)), "k", newer="t")
    assert sorted(map(tuple, lake.read().collect())) == [(1, 10), (2, 20)]
    lake.write(spark.createDataFrame([(3, 1, "n")], "k int, t long, extra string"), "append")
    assert lake.read().where("extra IS NULL").count() == 2


def test_matching(spark):
    offers = spark.createDataFrame(
        [("s1", "p1", "Almond drink", "almond|drink", 1.0, True), ("s1", "p2", "Whole milk", "milk|whole", 2.0, True), ("s2", "p3", "Milk", "milk", 3.0, True), ("s2", "p4", "Milk", "milk", 1.0, False)],
        "store_id string, product_id string, product_name string, search_terms string, price double, in_stock boolean",
    )
    cart = spark.createDataFrame([("milk",), ("zzz",)], "query string")
    got = {(r.query, r.store_id): r for r in matching.answers(matching.match_at_stores(cart, offers), cart, offers).collect()}
    assert got["milk", "s1"].product_id == "p2" and got["milk", "s2"].product_id == "p3" and got["milk", "s1"].score == 1.0
    assert not got["zzz", "s1"].available and got["zzz", "s1"].method == "none" and len(got) == 4
    model = spark.createDataFrame([("milk", "p1", 0.99), ("zzz", "p3", 0.8), ("zzz", "p2", 0.5), ("milk", "p3", 0.6)], "query string, product_id string, score double")
    both = {(r.query, r.store_id): (r.product_id, r.score, r.method) for r in matching.match_at_stores(cart, offers, model).collect()}
    assert both == {("milk", "s1"): ("p2", 1.0, "fuzzy"), ("milk", "s2"): ("p3", 1.0, "fuzzy"), ("zzz", "s2"): ("p3", 0.8, "semantic")}
    summary = matching.match_items(matching.match_at_stores(cart, offers)).collect()
    assert [(r["query"], r.product_name, r.num_stores) for r in summary] == [("milk", "Whole milk", 2)]


def test_answers_score_what_no_store_has(spark):
    """Below the threshold the best score is given without its product, by comparing the query with every text."""
    offers = spark.createDataFrame(
        [("s1", "p1", "Almond drink", "almond|drink", 1.0, True), ("s2", "p2", "Milk", "milk", 3.0, True), ("s2", "p3", "Silk", "", 3.0, False), ("s3", "p4", "xyx", None, 1.0, True)],
        "store_id string, product_id string, product_name string, search_terms string, price double, in_stock boolean",
    )
    cart = spark.createDataFrame([("milk",), ("silk",)], "query string")
    got = {(r["query"], r.store_id): (r.product_id, r.price, r.score, r.method, r.available) for r in matching.answers(matching.match_at_stores(cart, offers), cart, offers).collect()}
    none = lambda score: (None, None, score, "none", False)
    assert got == {
        ("milk", "s1"): none(0.444), ("milk", "s2"): ("p2", 3.0, 1.0, "fuzzy", True), ("milk", "s3"): none(0.0),
        ("silk", "s1"): none(0.444), ("silk", "s2"): ("p2", 3.0, 0.75, "fuzzy", True), ("silk", "s3"): none(0.0),
    }


def test_plans_are_optimal(spark):
    import itertools
    import random

    rng = random.Random(5)
    stores = [("a", 1.0), ("b", 3.0), ("c", 0.5), ("d", 2.0)]
    options = [(f"i{k}", s, round(rng.uniform(1, 30), 2), rng.choice([1.0, 0.8])) for k in range(5) for s, _ in stores if rng.random() < 0.7]
    cart = [(f"i{k}", k % 2 + 1) for k in range(6)]
    w = planner.Weights()
    best = None
    for n in range(3 + 1):
        for chosen in itertools.combinations(stores, n):
            total = sum(2.5 + 0.4 * 2 * km for _, km in chosen)
            for item, qty in cart:
                costs = [qty * p + 6 * (1 - x) for i, s, p, x in options if i == item and s in {c for c, _ in chosen}]
                total += min([25.0, *costs])
            best = total if best is None else min(best, total)
    c, o = spark.createDataFrame(cart, "item string, qty int"), spark.createDataFrame(options, "item string, store_id string, price double, score double")
    sets = planner.store_sets(spark.createDataFrame(stores, "store_id string, km double"), 3)
    assert sets.count() == 1 + 4 + 6 + 4
    costs = planner.plan_costs(c, o, sets, w)
    plan = planner.best_plan(costs)
    assert plan.first().objective == pytest.approx(best, abs=0.001)
    found = planner.search(c, o, spark.createDataFrame(stores, "store_id string, km double"), 3)
    assert planner.best_plan(found.plans).first().set_id == plan.first().set_id
    assert planner.single_store_plan(costs).first().objective >= plan.first().objective
    lines = planner.assignments(plan, c, o).collect()
    assert len(lines) == 6 and next(r for r in lines if r.item == "i5").store_id is None
    row = planner.recommended(costs).first()
    assert (row.recommended == "multi_store") == (row.multi_objective < row.single_objective)


def test_land_keeps_rows(spark):
    landed = medallion.land(products(spark), "r", "t", "s")
    assert landed.count() == 9 and {"run_id", "source_system", "schema_version"} <= set(landed.columns)
    assert landed.where(F.col("run_id") == "r").count() == 9
