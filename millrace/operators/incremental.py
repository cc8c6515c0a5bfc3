"""Silver and gold kept up by changes instead of rebuilds.

The latest staged row of each product, store and price is kept as a table (the states). A batch is held against the states of its own keys; what differs is a change, so rows
that arrive twice or late have none. Changes give the touched products, whose offers and per-product rows are made anew and replace the old ones, also by nothing:
a product that no longer passes the filters, or whose stores lost their coordinates, goes from all tables. Tables by product are read through their file
indexes. Category statistics are sums of what came less what went, over one row a product; only where a category's lowest or highest price or cheapest offer went
is the category taken from its products' rows anew. Sums are decimals, so that they don't drift.

Where the touched products are as many as all, gold is rebuilt from the states instead.

A marker is set before the first table changes and cleared after the last. Where it is still set, or a table is missing, the next run rebuilds all from the states and bronze.
Rows whose key is null take part nowhere: they join nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.text import half_up
from millrace.operators import medallion, quality

STATES = {
    "latest_products": (["barcode"], ["last_modified_t", "ingested_at"]),
    "latest_stores": (["store_id"], ["ingested_at"]),
    "latest_prices": (["store_id", "barcode"], ["observed_at", "event_id"]),
}
#: Derived tables and the key that their files are arranged by.
DERIVED = {
    "dim_product": "barcode", "dim_store": "store_id", "fact_inventory": "barcode", "store_product_offers": "product_id", "product_catalog": "product_id",
    "cheapest_products": "product_id", "product_search_index": "product_id", "price_states": "product_id", "category_states": "category", "category_price_stats": "category",
}
SUM = "decimal(28,10)"
# A batch with a row for so many of a state makes it anew: hardly any of its files is without one.
MANY = 8


# Aggregate states

def price_states(offers: DataFrame) -> DataFrame:
    """A row for each product in stock: its offers, prices (with how many aren't finite), their sum and ends, and its cheapest offer (ties: the least store name)."""
    price = F.col("price").cast("double")
    finite = price.isNotNull() & ~F.isnan(price) & (F.abs(price) != float("inf"))
    cheapest = F.when(F.col("price").isNotNull() & F.col("store_name").isNotNull(), F.struct(price.alias("price"), "store_name"))
    return (
        offers.where("in_stock")
        .groupBy("product_id", "category")
        .agg(
            F.count("*").alias("offers"), F.count("price").alias("priced"), F.count_if(price.isNotNull() & ~finite).alias("odd"),
            F.coalesce(F.sum(F.when(finite, price).try_cast(SUM)), F.lit(0)).cast(SUM).alias("total"), F.min(price).alias("low"), F.max(price).alias("high"), F.min(cheapest).alias("cheapest"),
        )
    )


def category_states(states: DataFrame) -> DataFrame:
    total = lambda c: F.sum(c).cast("long").alias(c)
    return states.groupBy("category").agg(
        F.count("*").alias("products"), total("offers"), total("priced"), total("odd"), F.sum("total").cast(SUM).alias("total"),
        F.min("low").alias("low"), F.max("high").alias("high"), F.min("cheapest").alias("cheapest"),
    )


def category_stats(states: DataFrame) -> DataFrame:
    """The rows of ``medallion.category_price_stats``; with prices that aren't finite the average is NaN."""
    average = F.when(F.col("odd") > 0, F.lit(float("nan"))).when(F.col("priced") > 0, half_up(F.col("total").cast("double") / F.col("priced")))
    return states.select(
        "category", F.col("products").alias("num_products"), F.col("offers").alias("num_offers"), half_up(F.col("low")).alias("min_price"), average.alias("avg_price"),
        half_up(F.col("high")).alias("max_price"), F.col("cheapest.store_name").alias("cheapest_store"),
    )


def shifted(before: DataFrame, came: DataFrame, went: DataFrame) -> DataFrame:
    """The states of the categories that rows came to or went from, with ``stale`` where an end went and nothing as good came, so that the products must be asked. Products of 0: none are left.

    before: category states. came, went: price states of the touched products, new and old.
    """
    counts = ["products", "offers", "priced", "odd", "total"]
    part = lambda df, kind, sign: df.select("category", F.lit(kind).alias("kind"), *[(F.col(c) * sign).cast(df.schema[c].dataType).alias(c) for c in counts], "low", "high", "cheapest")
    one = F.lit(1).cast("long")
    rows = part(before, "held", 1).unionByName(part(came.withColumn("products", one), "came", 1)).unionByName(part(went.withColumn("products", one), "went", -1))
    of = lambda c, kind: F.when(F.col("kind") == kind, F.col(c))
    ends = {"low": F.min, "high": F.max, "cheapest": F.min}
    summed = rows.groupBy("category").agg(
        F.count_if(F.col("kind") != "held").alias("_changes"), *[F.sum(c).cast(SUM if c == "total" else "long").alias(c) for c in counts],
        *[f(of(c, kind)).alias(f"_{kind}_{c}") for c, f in ends.items() for kind in ("held", "came", "went")],
        *[f(F.when(F.col("kind") != "went", F.col(c))).alias(c) for c, f in ends.items()],
    )

    def stale(c: str) -> Column:
        held, new, old = (F.col(f"_{k}_{c}") for k in ("held", "came", "went"))
        as_good = new >= held if c == "high" else new <= held
        return F.coalesce(old == held, F.lit(False)) & ~F.coalesce(as_good, F.lit(False))

    return summed.where("_changes > 0").select("category", *counts, *ends, (stale("low") | stale("high") | stale("cheapest")).alias("stale"))


# Steps

def mark(lake, state: str) -> None:
    lake["applied"].write(lake.spark.createDataFrame([(state,)], "state string"))


def clean(lake) -> bool:
    """Whether the last change reached every table."""
    tables = [*STATES, *DERIVED, "applied", "tallies"]
    return all(lake[n].exists() for n in tables) and lake["applied"].read().first().state == "whole"


def _arranged(df: DataFrame, key: str) -> DataFrame:
    """All rows of a key in one file, so that the file index leaves out the others."""
    return df.repartition(key)


def _latest(staged: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest row of each key, arranged by the last of them: one shuffle by it serves both."""
    return medallion.latest(_arranged(staged.dropna(subset=keys), keys[-1]), keys, order)


def store_states(lake, **staged: DataFrame) -> None:
    """States from all staged rows."""
    for name, df in staged.items():
        lake[name].write(_latest(df, *STATES[name]))


def advance(lake, name: str, staged: DataFrame) -> DataFrame:
    """Brings a state up to a batch of staged rows; gives the latest rows that are new or differ, also when read later.

    A batch of many rows would have every file rewritten and the state read and shuffled several times for that: it makes the state anew, in one shuffle of both, and each row tells whether it changed.
    """
    keys, order = STATES[name]
    table, batch, changes, staged = lake[name], lake[f"batch_{name}"], lake[f"changed_{name}"], staged.dropna(subset=keys)
    if not table.exists():
        table.write(_latest(staged, keys, order))
        return table.read()
    n = staged.count()
    if not n:
        return lake.spark.createDataFrame([], staged.schema)
    held = table.read().select(*staged.columns)
    if n * MANY >= held.count():
        best = _best(held, staged, keys, order, keys[-1])
        table.write(best.select(*keys, "_best.*", _moved().alias("_changed")).select(*staged.columns, "_changed"))
        return table.read().where("_changed").select(*staged.columns)
    batch.write(medallion.latest(staged, keys, order))
    rows = batch.read()
    changes.write(_newer(table.matching(rows, keys).select(*rows.columns), rows, keys, order))
    changed = changes.read()
    if not changed.isEmpty():
        table.replace(changed, changed, keys)
    return changed


def _best(held: DataFrame, rows: DataFrame, keys: list[str], order: list[str], by: str | None = None) -> DataFrame:
    """keys, _best (the latest of both, as ``medallion.latest`` takes them) and _old (the held one). Each row is shuffled once; with ``by`` whole, to files of that column's values."""
    row = F.struct(*order, *[c for c in rows.columns if c not in [*keys, *order]])
    both = held.withColumn("_held", F.lit(True)).unionByName(rows.withColumn("_held", F.lit(False)))
    both = _arranged(both, by) if by else both
    return both.groupBy(*keys).agg(F.max(row).alias("_best"), F.max(F.when(F.col("_held"), row)).alias("_old"))


def _moved() -> Column:
    return ~F.col("_best").eqNullSafe(F.col("_old"))


def _newer(held: DataFrame, rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The latest rows of both where they aren't the held ones; held has one row a key."""
    return _best(held, rows, keys, order).where(_moved()).select(*keys, "_best.*").select(*rows.columns)


def rebuild(lake) -> dict[str, dict[str, int]]:
    """Silver and gold from the states; gives what the standard checks counted."""
    spark, seen = lake.spark, {}

    def put(name: str, df: DataFrame, watch: quality.Watch | None = None, there: bool = False) -> DataFrame:
        """``there``: the rows of a key are in one task already."""
        rows = watch.rows if watch else df
        lake[name].write(rows if there else _arranged(rows, DERIVED[name]))
        if watch:
            seen[name] = watch.counts()
        return lake[name].read()

    watched = lambda name, df, there=False: put(name, df, quality.watch(df, name), there)
    # A state that was made anew has the rows of a product in one file, which one task reads.
    products = watched("dim_product", medallion.enriched_products(lake["latest_products"].read(), medallion.category_map(spark)), there=lake["latest_products"].made_anew())
    located = medallion.located(lake["latest_stores"].read())
    stores = put("dim_store", located, quality.Watch(located))
    inventory = put("fact_inventory", medallion.keyed_prices(lake["latest_prices"].read()), there=lake["latest_prices"].made_anew())
    offers = watched("store_product_offers", medallion.offers(inventory, stores, products, arranged=True), there=True)
    put("product_catalog", medallion.product_catalog(products), there=True)
    put("cheapest_products", medallion.cheapest_products(offers))
    put("product_search_index", medallion.product_search_index(offers))
    categories = put("category_states", category_states(put("price_states", price_states(offers))))
    put("category_price_stats", category_stats(categories))
    return seen


def propagate(lake, products: DataFrame, stores: DataFrame, prices: DataFrame) -> dict[str, dict[str, int]]:
    """Carries changed states into silver and gold. Gives the checks' counts of the whole tables, and under ``touched`` the number of products made anew.

    Where as many are touched as there are products, all is made anew: replacing would rewrite every file, too, and read all tables more than once.
    """
    spark, tallies = lake.spark, _tallies(lake)

    def swap(name: str, touched: DataFrame, rows: DataFrame, key: str | list[str]) -> None:
        """Replaces the touched rows, and moves the tallies by the old and the new ones."""
        table = lake[name]
        old = table.matching(touched, key)
        table.replace(touched, rows, key)
        if name in tallies:
            gone, new = (quality.tally(df, name) for df in (old, table.matching(touched, key)))
            tallies[name] = {check: n - gone[check] + new[check] for check, n in tallies[name].items()}

    inventory, moved = lake["fact_inventory"], not stores.isEmpty()
    asked = products.select("barcode").union(prices.select("barcode"))
    if moved:
        asked = asked.union(inventory.matching(stores, "store_id").select("barcode"))
    lake["touched"].write(asked.distinct().select("barcode", F.col("barcode").alias("product_id")))
    touched = lake["touched"].read()
    tallies["touched"] = {"total": touched.count()}
    if tallies["touched"]["total"] >= max(tallies["dim_product"]["total"], 1):
        return rebuild(lake) | {"touched": tallies["touched"]}

    if moved:
        swap("dim_store", stores, medallion.located(stores), "store_id")
    if not products.isEmpty():
        swap("dim_product", products, medallion.enriched_products(products, medallion.category_map(spark)), "barcode")
    if not prices.isEmpty():
        swap("fact_inventory", prices, medallion.keyed_prices(prices), ["store_id", "barcode"])
    if not tallies["touched"]["total"]:
        return tallies

    rows = lake["dim_product"].matching(touched, "barcode")
    swap("store_product_offers", touched, medallion.offers(inventory.matching(touched, "barcode"), lake["dim_store"].read(), rows), "product_id")
    offers = lake["store_product_offers"].matching(touched, "product_id")
    swap("product_catalog", touched, medallion.product_catalog(rows), "product_id")
    swap("cheapest_products", touched, medallion.cheapest_products(offers), "product_id")
    swap("product_search_index", touched, medallion.product_search_index(offers), "product_id")
    went = lake["price_states"].matching(touched, "product_id")
    swap("price_states", touched, price_states(offers), "product_id")
    came = lake["price_states"].matching(touched, "product_id")

    # As many rows as categories.
    lake["changed_categories"].write(shifted(lake["category_states"].read(), came, went))
    changed = lake["changed_categories"].read()
    stale = changed.where("stale AND products > 0").select("category")
    states = changed.where("NOT stale AND products > 0").drop("stale")
    if not stale.isEmpty():
        states = states.unionByName(category_states(lake["price_states"].read().join(F.broadcast(stale), "category", "left_semi")))
    lake["category_states"].replace(changed, states, "category")
    lake["category_price_stats"].replace(changed, category_stats(lake["category_states"].matching(changed, "category")), "category")
    return tallies


def apply(lake, full: bool, fresh: DataFrame, raw_stores: DataFrame, events: DataFrame) -> dict[str, dict[str, int]]:
    """The rows landed by a run, carried to gold. ``full``: stores and events are all there are, else those that are new (older ones have no effect); bronze is in the lake."""
    stores, prices = medallion.stage_stores(raw_stores), medallion.stage_price_events(events)
    whole = full or not clean(lake)
    mark(lake, "begun")
    if whole:
        store_states(lake, latest_products=medallion.well_formed_products(lake["bronze_products"].read()))
        if full:
            store_states(lake, latest_stores=stores, latest_prices=prices)
        else:
            advance(lake, "latest_stores", stores)
            advance(lake, "latest_prices", prices)
        counts = rebuild(lake)
    else:
        counts = propagate(lake, advance(lake, "latest_products", medallion.well_formed_products(fresh)), advance(lake, "latest_stores", stores), advance(lake, "latest_prices", prices))
    rows = [(table, check, n) for table, of in counts.items() if table != "touched" for check, n in of.items()]
    lake["tallies"].write(lake.spark.createDataFrame(rows, "table string, check string, n long"))
    mark(lake, "whole")
    return counts


def _tallies(lake) -> dict[str, dict[str, int]]:
    """What the checks count in the whole tables, as of the last run: a row a check."""
    out: dict[str, dict[str, int]] = {}
    for r in lake["tallies"].read().collect():
        out.setdefault(r.table, {})[r.check] = r.n
    return out
