"""Bronze to silver to gold, as functions from DataFrames to DataFrames.

Choices where batch paths could differ: malformed rows go before the latest row is taken, so they
never hide a good one; bar codes are trimmed first; search terms are distinct and capped.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import price, text
from millrace.functions.events import inventory_key

# The product taxonomy (key, group, search term, base price, words that rule the term out).
TAXONOMY = (
    ("milk", "dairy", "milk", 1.20, ("almond", "soy", "oat", "coconut", "cashew", "plant", "rice milk")),
    ("eggs", "dairy", "eggs", 3.00, ()),
    ("chicken breast", "meat", "chicken breast", 7.50, ()),
    ("rice", "grains", "rice", 3.20, ()),
    ("spinach", "produce", "spinach", 2.20, ()),
    ("yogurt", "dairy", "yogurt", 2.80, ()),
    ("cheese", "dairy", "cheese", 3.40, ()),
    ("bread", "bakery", "bread", 1.90, ()),
    ("pasta", "grains", "pasta", 1.30, ()),
    ("cereal", "breakfast", "cereal", 3.60, ()),
    ("coffee", "beverages", "coffee", 5.40, ()),
    ("orange juice", "beverages", "orange juice", 2.40, ()),
)


def category_map(spark: SparkSession) -> DataFrame:
    """taxonomy_key, product_group, term, base_price, exclude: a dozen rows, so joins broadcast it."""
    return spark.createDataFrame([(k, g, t, p, list(x)) for k, g, t, p, x in TAXONOMY], "taxonomy_key string, product_group string, term string, base_price double, exclude array<string>")


def filled(*columns: str) -> Column:
    """Neither null nor empty."""
    out = F.lit(True)
    for c in columns:
        out = out & (F.coalesce(F.length(c), F.lit(0)) > 0)
    return out


def latest(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row of each key with the greatest ``order``, nulls lowest; then the greatest row, so the result doesn't depend on partitions.

    An aggregate, so that all but one row a key and task go before the shuffle.
    """
    rest = [c for c in df.columns if c not in keys]
    best = F.max_by(F.struct(*rest), F.struct(*order, *[c for c in rest if c not in order])).alias("_best")
    return df.groupBy(*keys).agg(best).select(*keys, "_best.*").select(df.columns)


# Staging

def stage_products(raw: DataFrame) -> DataFrame:
    return raw.select(
        F.trim("barcode").alias("barcode"), F.trim("product_name").alias("product_name"), "brands", "categories_tags", "quantity", "lang",
        F.col("last_modified_t").cast("long").alias("last_modified_t"), "taxonomy_key", "ingested_at",
    )


def stage_stores(raw: DataFrame) -> DataFrame:
    return raw.select("store_id", F.trim("name").alias("name"), F.trim("chain").alias("chain"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"), "ingested_at")


def stage_price_events(raw: DataFrame) -> DataFrame:
    return raw.select("event_id", "store_id", "barcode", F.col("price").cast("double").alias("price"), "in_stock", "observed_at")


# Silver

def well_formed_products(raw: DataFrame) -> DataFrame:
    return stage_products(raw).where(filled("barcode", "product_name"))


def latest_products(raw: DataFrame) -> DataFrame:
    """The latest well-formed staged row of each bar code."""
    return latest(well_formed_products(raw), ["barcode"], ["last_modified_t", "ingested_at"])


def enriched_products(rows: DataFrame, categories: DataFrame, english_only: bool = True) -> DataFrame:
    """Staged rows of known categories, typed and enriched."""
    if english_only:
        rows = rows.where((F.col("lang").isNull() | F.col("lang").isin("en", "")) & text.is_ascii(F.col("product_name")))
    joined = rows.join(F.broadcast(categories), "taxonomy_key").withColumn("product_name", text.squeeze(F.col("product_name")))
    return joined.select(
        "barcode", "product_name", F.coalesce("brands", F.lit("")).alias("brands"), F.col("taxonomy_key").alias("category"), "product_group",
        text.quantity_value(F.col("quantity")).alias("size_value"), text.quantity_unit(F.col("quantity")).alias("size_unit"),
        price.base_price(F.col("base_price"), F.col("barcode")).alias("base_price"),
        text.search_terms(F.col("product_name"), F.col("brands"), F.col("term"), F.col("exclude")).alias("search_terms"), "categories_tags", "last_modified_t",
    )


def dim_product(raw: DataFrame, categories: DataFrame, english_only: bool = True, strict_latest: bool = False) -> DataFrame:
    """The latest well-formed row of each bar code of a known category, typed and enriched.

    ``strict_latest`` takes the latest row first, so that a malformed newer row hides an older one.
    """
    if strict_latest:
        rows = latest(stage_products(raw), ["barcode"], ["last_modified_t", "ingested_at"]).where(filled("barcode", "product_name"))
    else:
        rows = latest_products(raw)
    return enriched_products(rows, categories, english_only)


def latest_stores(raw: DataFrame) -> DataFrame:
    return latest(stage_stores(raw), ["store_id"], ["ingested_at"])


def located(rows: DataFrame) -> DataFrame:
    """Staged stores that have coordinates."""
    return rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("store_id", "name", "chain", "lat", "lon")


def dim_store(raw: DataFrame) -> DataFrame:
    """The latest row of each store, if it has coordinates."""
    return located(latest_stores(raw))


def latest_prices(events: DataFrame) -> DataFrame:
    """The latest staged event of each store and product."""
    return latest(stage_price_events(events), ["store_id", "barcode"], ["observed_at", "event_id"])


def keyed_prices(rows: DataFrame) -> DataFrame:
    return rows.select(inventory_key(F.col("store_id"), F.col("barcode")).alias("inv_key"), "store_id", "barcode", "price", "in_stock", "observed_at")


def fact_inventory(events: DataFrame) -> DataFrame:
    """The latest price of each store and product."""
    return keyed_prices(latest_prices(events))


# Gold

def product_catalog(products: DataFrame) -> DataFrame:
    return products.select(F.col("barcode").alias("product_id"), "product_name", "brands", "category", "product_group", "size_value", "size_unit", "base_price", "search_terms")


def offers(inventory: DataFrame, stores: DataFrame, products: DataFrame, arranged: bool = False) -> DataFrame:
    """Store x product x price. Dimensions are joined as their sizes ask for; nothing is broadcast unseen. With ``arranged`` a product's prices come to one task before a join widens them."""
    prices = inventory.select("store_id", "barcode", "price", "in_stock")
    return (
        (prices.repartition("barcode") if arranged else prices)
        .join(stores.withColumnRenamed("name", "store_name"), "store_id")
        .join(products.withColumnRenamed("barcode", "product_id"), F.col("barcode") == F.col("product_id"))
        .select("store_id", "store_name", "chain", "lat", "lon", "product_id", "product_name", "category", F.coalesce("size_unit", F.lit("each")).alias("unit"), "search_terms", "price", "in_stock")
    )


def category_price_stats(offers: DataFrame) -> DataFrame:
    """Counts and price range of the offers in stock, and the cheapest store (ties: the least name)."""
    cheapest = F.min(F.when(F.col("price").isNotNull() & F.col("store_name").isNotNull(), F.struct("price", "store_name")))
    return (
        offers.where("in_stock")
        .groupBy("category")
        .agg(
            F.countDistinct("product_id").alias("num_products"), F.count("*").alias("num_offers"), text.half_up(F.min("price")).alias("min_price"),
            text.half_up(F.avg("price")).alias("avg_price"), text.half_up(F.max("price")).alias("max_price"), cheapest["store_name"].alias("cheapest_store"),
        )
    )


def cheapest_products(offers: DataFrame) -> DataFrame:
    """The cheapest offer in stock of each product, null prices last; ties go to the least store_id."""
    rest = F.struct("product_name", "category", "price", "store_name")
    best = offers.where("in_stock").groupBy("product_id").agg(F.min_by(rest, F.struct(F.col("price").isNull(), "price", "store_id")).alias("b"))
    return best.select("product_id", "b.product_name", "b.category", text.half_up(F.col("b.price")).alias("cheapest_price"), F.col("b.store_name").alias("cheapest_store"))


def product_search_index(offers: DataFrame) -> DataFrame:
    return offers.groupBy("product_id").agg(
        F.min("product_name").alias("product_name"), F.min("category").alias("category"), F.min("search_terms").alias("search_terms"),
        F.count_if("in_stock").alias("num_stores_in_stock"), text.half_up(F.min("price")).alias("min_price"),
    )


def land(raw: DataFrame, run_id: str, ingested_at: str, source: str, schema_version: str = "1") -> DataFrame:
    """Raw rows with the four lineage columns."""
    return raw.withColumns({"run_id": F.lit(run_id), "ingested_at": F.lit(ingested_at), "source_system": F.lit(source), "schema_version": F.lit(schema_version)})
