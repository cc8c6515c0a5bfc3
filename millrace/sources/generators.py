"""Seeded generators: scale events, demo stream messages, modelled stores and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions.price import uniform
from millrace.functions.text import half_up

# Chains with base multiplier, stock probability, default coverage, multipliers and coverage by product group; and the map's centre.
CHAINS = (
    ("ValueMart", 0.95, 0.95, 0.90, {}, {}),
    ("MegaSaver", 0.92, 0.94, 0.88, {"grains": 0.78, "bakery": 0.85, "breakfast": 0.80, "beverages": 0.82, "dairy": 0.95, "meat": 1.12, "produce": 1.10}, {"meat": 0.5, "produce": 0.5}),
    ("FreshFields", 1.16, 0.98, 0.97, {"produce": 0.98}, {}),
    ("GreenBasket", 1.10, 0.95, 0.35, {"produce": 0.72, "dairy": 0.90}, {"produce": 0.95, "dairy": 0.90}),
    ("ButcherBlock", 1.00, 0.97, 0.08, {"meat": 0.72}, {"meat": 0.97}),
    ("QuickStop", 1.30, 0.90, 0.55, {}, {}),
)
CENTRE = (38.7223, -9.1393)


def scale_events(spark: SparkSession, n_rows: int, n_days: int = 30, seed: int = 7, partitions: int | None = None) -> DataFrame:
    """event_id, store_id, product_id, price, in_stock, event_date; each column is a function of event_id and the seed."""
    ids = spark.range(0, n_rows, 1, partitions) if partitions else spark.range(n_rows)
    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n))
    day = F.date_add(F.lit("2024-01-01").cast("date"), F.floor(F.col("id") * n_days / F.lit(max(n_rows, 1))).cast("int"))
    return ids.select(
        F.col("id").alias("event_id"), pick("store", 50).cast("int").alias("store_id"), pick("product", 5000).cast("int").alias("product_id"),
        half_up(uniform(seed, F.col("id"), F.lit("price"), low=0.5, high=20.0)).alias("price"), (uniform(seed, F.col("id"), F.lit("stock")) < 0.95).alias("in_stock"), day.cast("string").alias("event_date"),
    )


def demo_messages(spark: SparkSession, n: int = 500, seed: int = 1, n_malformed: int = 10) -> DataFrame:
    """key, value (JSON text): about a tenth of version 1, some bad prices, and malformed messages at the end."""
    ids = spark.range(n)
    old = uniform(seed, F.col("id"), F.lit("version")) < 0.10
    bad = uniform(seed, F.col("id"), F.lit("bad")) < 0.06
    price = F.when(bad, F.lit(-1.0)).otherwise(half_up(uniform(seed, F.col("id"), F.lit("price"), low=0.5, high=20.0)))
    stamp = F.date_format(F.timestamp_seconds(F.lit(1704096000) + F.col("id")), "yyyy-MM-dd'T'HH:mm:ss")
    pick = lambda salt, n: F.pmod(F.xxhash64("id", F.lit(seed), F.lit(salt)), F.lit(n)).cast("int")
    shared = [F.col("id").alias("event_id"), pick("store", 8).alias("store_id"), pick("product", 200).alias("product_id"), price.alias("price"), stamp.alias("observed_at")]
    first = F.to_json(F.struct(F.lit(1).alias("schema_version"), *shared))
    second = F.to_json(F.struct(F.lit(2).alias("schema_version"), *shared, (uniform(seed, F.col("id"), F.lit("stock")) < 0.9).alias("in_stock"), F.lit("USD").alias("currency")))
    rows = ids.select(pick("store", 8).cast("string").alias("key"), F.when(old, first).otherwise(second).alias("value"))
    return rows.unionByName(spark.range(n_malformed).select(F.lit(None).cast("string").alias("key"), F.format_string("{not json %d", "id").alias("value")))


def modelled_stores(spark: SparkSession, n_stores: int = 8, seed: int = 42) -> DataFrame:
    """Stores of the chains in turn, scattered around the centre."""
    chains = F.array(*[F.lit(c[0]) for c in CHAINS])
    df = spark.range(n_stores)
    chain = F.element_at(chains, (F.col("id") % len(CHAINS) + 1).cast("int"))
    at = lambda salt, centre: F.round(F.lit(centre) + uniform(seed, F.col("id"), F.lit(salt), low=-0.022, high=0.022), 6)
    return df.select(
        F.format_string("s%02d", "id").alias("store_id"), F.concat(chain, F.lit(" #"), (F.col("id") + 1).cast("string")).alias("name"), chain.alias("chain"), at("lat", CENTRE[0]).alias("lat"), at("lon", CENTRE[1]).alias("lon"),
        F.lit("2024-01-01T06:00:00").alias("ingested_at"), F.lit("modeled_pricing").alias("source_system"),
    )


def modelled_prices(products: DataFrame, stores: DataFrame, n_days: int = 2, max_products: int = 120, seed: int = 42) -> DataFrame:
    """Price events of the products (barcode, product_group, base_price) that each store carries: by chain coverage, up to ``max_products`` in seeded order."""
    spark = products.sparkSession
    rows = [(name, base, stock, coverage, mult, cover) for name, base, stock, coverage, mult, cover in CHAINS]
    chains = spark.createDataFrame(rows, "chain string, base_mult double, stock_p double, coverage double, mult map<string,double>, cover map<string,double>")
    # A store's assortment is its products by definition; stores are the small, broadcast side.
    pairs = products.select("barcode", "product_group", "base_price").crossJoin(F.broadcast(stores.select("store_id", "chain").join(F.broadcast(chains), "chain")))
    carried = pairs.where(uniform(seed, F.col("store_id"), F.col("barcode"), F.lit("carry")) <= F.coalesce(F.col("cover")[F.col("product_group")], F.col("coverage")))
    order = F.row_number().over(Window.partitionBy("store_id").orderBy(F.xxhash64("barcode", F.lit(seed)), "barcode"))
    kept = carried.withColumn("_n", order).where(F.col("_n") <= max_products)
    days = kept.select("*", F.explode(F.sequence(F.lit(0), F.lit(n_days - 1))).alias("day"))
    key = [F.col("store_id"), F.col("barcode"), F.col("day")]
    drift = uniform(seed, *key, F.lit("a"), low=0.95, high=1.06) * uniform(seed, *key, F.lit("b"), low=0.97, high=1.03)
    price = F.col("base_price") * F.col("base_mult") * F.coalesce(F.col("mult")[F.col("product_group")], F.lit(1.0)) * drift
    date = F.date_add(F.lit("2024-01-01").cast("date"), F.col("day")).cast("string")
    return days.select(
        F.concat(F.lit("e"), F.lpad(F.hex(F.xxhash64(*key)), 16, "0")).alias("event_id"), "store_id", "barcode", half_up(price).alias("price"), (uniform(seed, *key, F.lit("stock")) < F.col("stock_p")).alias("in_stock"),
        F.concat(date, F.lit("T08:00:00")).alias("observed_at"), date.alias("event_date"), F.lit("modeled_pricing").alias("source_system"),
    )
