"""Silver and gold by changes: equal to a rebuild after every run, in proportion to the change, whole again after a failure."""

import pytest
from pyspark.sql import functions as F

from millrace.operators import incremental, medallion, pipeline, quality, runs
from millrace.plans import tables as t
from tests.oracle import SF

GOLD = ("dim_product", "dim_store", "fact_inventory", "store_product_offers", "product_catalog", "cheapest_products", "product_search_index", "category_price_stats")
PRODUCT = "barcode string, product_name string, brands string, categories_tags string, quantity string, lang string, last_modified_t long, taxonomy_key string"
STORE = "store_id string, name string, chain string, lat double, lon double, ingested_at string"
EVENT = "event_id string, store_id string, barcode string, price double, in_stock boolean, observed_at string"


def product(code, name="rice", at=1, key="rice", lang="en"):
    return code, name, None, None, "1 kg", lang, at, key


def store(key, name, lat=1.0, at="1"):
    return key, name, "c", lat, 1.0, at


def event(k, at, code, price, stock=True, seen="2024-01-01"):
    return str(k), at, code, price, stock, seen


def sources(spark, products=(), stores=(), events=()):
    return pipeline.Sources(spark.createDataFrame(list(products), PRODUCT), spark.createDataFrame(list(stores), STORE), spark.createDataFrame(list(events), EVENT))


def rows(df):
    return sorted(map(repr, (tuple(r[c] for c in sorted(df.columns)) for r in df.collect())))


def rebuilt(lake, stores, events):
    """Gold from all rows that ever came, by the plain functions."""
    products, places = medallion.dim_product(lake["bronze_products"].read(), medallion.category_map(lake.spark)), medallion.dim_store(stores)
    inventory = medallion.fact_inventory(events.dropna(subset=["store_id", "barcode"]))
    offers = medallion.offers(inventory, places, products)
    made = (products, places, inventory, offers, medallion.product_catalog(products), medallion.cheapest_products(offers), medallion.product_search_index(offers), medallion.category_price_stats(offers))
    return dict(zip(GOLD, made, strict=True))


def equal(lake, stores, events):
    for name, want in rebuilt(lake, stores, events).items():
        assert rows(lake[name].read()) == rows(want.select(lake[name].read().columns)), name


BATCHES = (
    dict(products=[product("1"), product("2", "brown rice"), product("3", "milk", key="milk"), product("4", "eggs", key="eggs")], stores=[store("a", "A"), store("b", "B"), store("c", "C", None)],
         events=[event(1, "a", "1", 2.0), event(2, "b", "1", 3.0), event(3, "a", "2", 5.0), event(4, "b", "3", 1.0), event(5, "c", "3", 0.1), event(6, "a", "4", 4.0), event(6, "a", "9", 4.0)]),
    # The lowest price goes up; a late event and one of equal time; a store gets a place; an event without a store.
    dict(stores=[store("c", "C", 2.0, "2")], events=[event(7, "a", "1", 9.0, seen="2024-01-02"), event(8, "b", "1", 1.0, seen="2023-01-01"), event(0, "a", "2", 0.5), event(9, None, "1", 0.2)]),
    # A category's only product goes by its language; another changes its category; one that offers waited for comes; a malformed newer row hides nothing.
    dict(products=[product("4", "oeufs", 9, "eggs", "fr"), product("2", "bread", 9, "bread"), product("9", "rice", 9), product("1", "", 20)], events=[event(1, "a", "1", 2.0)]),
    # The cheapest store is renamed, another loses its place; a price that isn't there, and the last offer of a product out of stock.
    dict(stores=[store("b", "Z", at="3"), store("c", "C", None, "3")], events=[event(11, "a", "9", None, seen="2024-02-01"), event(12, "a", "2", 5.0, False, "2024-02-01")]),
    # The product that went comes back.
    dict(products=[product("4", "eggs", 30, "eggs")]),
)


def test_gold_equals_a_rebuild_after_every_run(spark, tmp_path):
    lake = pipeline.Lake(spark, f"file://{tmp_path}/lake")
    stores, events, touched = [], [], []
    for k, batch in enumerate(BATCHES):
        stores, events = stores + batch.get("stores", []), events + batch.get("events", [])
        pipeline.run(lake, sources(spark, **batch), "incremental" if k else "full", f"r{k}", f"2024-01-0{k + 1}T00:00:00")
        equal(lake, spark.createDataFrame(stores, STORE), spark.createDataFrame(events, EVENT))
        got = {r.metric: int(r.value) for r in lake["metrics"].read().where(F.col("run_id") == f"r{k}").where("metric = 'touched'").collect()}
        touched.append(got.get("touched"))
        want = quality.run_checks(lake["bronze_products"].read().where(F.col("run_id") == f"r{k}"), lake["dim_product"].read(), lake["store_product_offers"].read(), f"r{k}", f"2024-01-0{k + 1}T00:00:00")
        columns = [c for c in want.columns]
        assert rows(lake["quality_results"].read().where(F.col("run_id") == f"r{k}").select(columns)) == rows(want)
        counts = runs.row_counts({n: lake[n].read() for n in ("dim_product", "dim_store", "store_product_offers")}, f"r{k}", f"2024-01-0{k + 1}T00:00:00")
        assert rows(lake["metrics"].read().where(F.col("run_id") == f"r{k}").where("metric = 'row_count'")) == rows(counts)
    # Late rows, rows of equal time that come second and rows that came before touch nothing: products 1, 3; 2, 4, 9; 1, 2, 3, 9; 4.
    assert touched == [None, 2, 3, 4, 1]


def test_a_run_that_broke_off_is_made_good_by_the_next(spark, tmp_path, monkeypatch):
    lake = pipeline.Lake(spark, f"file://{tmp_path}/lake")
    pipeline.run(lake, sources(spark, **BATCHES[0]), "full", "r0", "2024-01-01T00:00:00")

    def broken(*_):
        raise OSError("lost")

    with monkeypatch.context() as m:
        m.setattr(medallion, "cheapest_products", broken)
        with pytest.raises(OSError):
            pipeline.run(lake, sources(spark, **BATCHES[1]), "incremental", "r1", "2024-01-02T00:00:00")
    assert not incremental.clean(lake)
    pipeline.run(lake, sources(spark, **BATCHES[2]), "incremental", "r2", "2024-01-03T00:00:00")
    many = lambda name: spark.createDataFrame([r for b in BATCHES[:3] for r in b.get(name, [])], STORE if name == "stores" else EVENT)
    assert incremental.clean(lake)
    equal(lake, many("stores"), many("events"))


def test_few_files_are_read_for_a_small_change(spark, tmp_path):
    """Also after maintenance, which keeps the rows of a key together."""
    lake = pipeline.Lake(spark, f"file://{tmp_path}/lake")
    raw, stores, events = t.raw_products(spark, SF).drop("ingested_at"), t.raw_stores(spark, SF), t.price_events(spark, SF)
    pipeline.run(lake, pipeline.Sources(raw, stores, events), "full", "r0", "2024-01-01T00:00:00")
    names = ("store_product_offers", "price_states", "fact_inventory")
    for name in names:
        lake[name].write(lake[name].read().repartition(40, incremental.DERIVED[name]))
    one = events.where(F.col("barcode") == events.agg(F.max("barcode")).first()[0]).limit(1)
    change = one.withColumns({"price": F.lit(0.01), "observed_at": F.lit("2030-01-01T00:00:00"), "event_id": F.lit("new")})
    pipeline.run(lake, pipeline.Sources(raw.limit(0), stores.limit(0), change), "incremental", "r1", "2024-01-02T00:00:00")
    assert lake["metrics"].read().where("metric = 'touched'").first().value == 1
    assert all(lake[n].rewritten() <= 2 and lake[n].file_count() >= 39 for n in names)
    equal(lake, stores, events.unionByName(change))
    pipeline.maintain_lake(lake)
    assert all(lake[n].file_count() == 1 for n in names)
    equal(lake, stores, events.unionByName(change))


def test_all_is_made_anew_where_every_product_is_touched(spark, tmp_path):
    lake = pipeline.Lake(spark, f"file://{tmp_path}/lake")
    raw, stores, events = t.raw_products(spark, SF).drop("ingested_at"), t.raw_stores(spark, SF), t.price_events(spark, SF)
    pipeline.run(lake, pipeline.Sources(raw, stores, events), "full", "r0", "2024-01-01T00:00:00")
    change = events.withColumns({"price": F.col("price") + 1, "observed_at": F.lit("2030-01-01T00:00:00")})
    pipeline.run(lake, pipeline.Sources(raw.limit(0), stores.limit(0), change), "incremental", "r1", "2024-01-02T00:00:00")
    assert lake["metrics"].read().where("metric = 'touched'").first().value == events.select("barcode").distinct().count()
    assert lake["store_product_offers"].version() == 1 and lake["store_product_offers"].rewritten() == 0
    equal(lake, stores, events.unionByName(change))


def test_a_batch_of_many_rows_makes_the_state_anew(spark, tmp_path):
    """In one shuffle, without tables of batch and changes beside it; a product's rows stay in one file, also in what is made of the state. A small batch goes by changes again."""
    lake = pipeline.Lake(spark, f"file://{tmp_path}/lake")
    raw, stores, events = t.raw_products(spark, SF).drop("ingested_at"), t.raw_stores(spark, SF), t.price_events(spark, SF)
    pipeline.run(lake, pipeline.Sources(raw, stores, events), "full", "r0", "2024-01-01T00:00:00")
    change = events.where("price % 3 < 2").withColumn("observed_at", F.when(F.col("price") % 2 < 1, "2030-01-01T00:00:00").otherwise(F.lit("1990-01-01T00:00:00"))).withColumn("price", F.col("price") + 1)
    pipeline.run(lake, pipeline.Sources(raw.limit(0), stores.limit(0), change), "incremental", "r1", "2024-01-02T00:00:00")
    assert not lake["batch_latest_prices"].exists() and not lake["changed_latest_prices"].exists() and lake["latest_prices"].made_anew()
    for name, key in (("latest_prices", "barcode"), ("fact_inventory", "barcode"), ("store_product_offers", "product_id")):
        files = lake[name].read().select(key, F.input_file_name().alias("file")).distinct().groupBy(key).agg(F.count("*").alias("n"))
        assert lake[name].version() == 1 and files.where("n > 1").isEmpty(), name
    equal(lake, stores, events.unionByName(change))
    one = events.limit(1).withColumns({"price": F.lit(0.5), "observed_at": F.lit("2031-01-01T00:00:00")})
    pipeline.run(lake, pipeline.Sources(raw.limit(0), stores.limit(0), one), "incremental", "r2", "2024-01-03T00:00:00")
    assert lake["changed_latest_prices"].read().count() == 1 and not lake["latest_prices"].made_anew()
    equal(lake, stores, events.unionByName(change).unionByName(one))


def test_newer_rows_are_what_the_latest_of_both_has_more(spark):
    schema = "k string, at int, name string, price double"
    held = spark.createDataFrame([("a", 1, "x", 1.0), ("b", 2, "x", float("nan")), ("c", 3, None, None), ("d", 1, "x", 0.0), ("g", 1, "x", 1.0)], schema)
    batch = spark.createDataFrame([("a", 2, "x", 1.0), ("b", 2, "x", float("nan")), ("c", 3, None, None), ("d", 1, "x", 5.0), ("e", None, None, None), ("f", 1, "x", 1.0), ("g", 0, "y", 9.0)], schema)
    want = medallion.latest(held.unionByName(batch), ["k"], ["at"]).subtract(held)
    got = incremental._newer(held, batch, ["k"], ["at"])
    assert rows(got) == rows(want) and {r.k for r in got.collect()} == {"a", "d", "e", "f"}


def test_states_with_prices_that_are_not_numbers(spark):
    offers = spark.createDataFrame([("1", "rice", "A", float("nan"), True), ("1", "rice", "B", 2.0, True), ("2", "rice", "A", None, True), ("3", "milk", None, float("inf"), True), ("4", "eggs", "A", None, True), ("5", "tea", "A", 1.0, None)], "product_id string, category string, store_name string, price double, in_stock boolean")
    got = {r.category: r for r in incremental.category_stats(incremental.category_states(incremental.price_states(offers))).collect()}
    assert set(got) == {"rice", "milk", "eggs"}
    assert (got["rice"].num_products, got["rice"].num_offers, got["rice"].min_price, got["rice"].cheapest_store) == (2, 3, 2.0, "B")
    assert got["rice"].avg_price != got["rice"].avg_price and got["milk"].cheapest_store is None and got["eggs"].avg_price is None
