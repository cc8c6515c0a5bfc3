"""The medallion's raw relations, mapped from the driver's tables; and the same as SQL for oracles."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.operators import medallion
from millrace.operators.medallion import TAXONOMY
from millrace.session import table

KEYS = [k for k, *_ in TAXONOMY]
UNITS = ("g", "kg", "ml", "fl oz", "lb", "cl", "oz", "l", "boxes")
NOW = "2024-01-02T00:00:00"


def code(column: str):
    return F.lpad(F.col(column).cast("string"), 12, "0")


def price_events(spark: SparkSession, d: str, day: str | None = None) -> DataFrame:
    """lineitem as price events of stores (suppliers) and products (parts); of one day, if given, by a filter that the scan takes."""
    rows = table(spark, d, "lineitem")
    if day:
        begins = F.lit(day).cast(rows.schema["l_shipdate"].dataType)
        rows = rows.where((F.col("l_shipdate") >= begins) & (F.col("l_shipdate") < F.date_add(F.lit(day).cast("date"), 1).cast(rows.schema["l_shipdate"].dataType)))
    event = F.concat(F.lpad(F.col("l_orderkey").cast("string"), 12, "0"), F.lpad(F.col("l_linenumber").cast("string"), 4, "0"))
    return rows.select(
        event.alias("event_id"), F.col("l_suppkey").cast("string").alias("store_id"), code("l_partkey").alias("barcode"), (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"),
        (F.col("l_returnflag") != "R").alias("in_stock"), F.date_format("l_shipdate", "yyyy-MM-dd'T'HH:mm:ss").alias("observed_at"), F.date_format("l_shipdate", "yyyy-MM-dd").alias("event_date"),
    )


def raw_stores(spark: SparkSession, d: str) -> DataFrame:
    """supplier as stores; a chain for each nation, coordinates by arithmetic, some without."""
    key = F.col("s_suppkey")
    nations = table(spark, d, "nation").select("n_nationkey", "n_name")
    lat = F.when(key % 11 != 0, F.lit(38.0) + (key % 100) / F.lit(100.0))
    return table(spark, d, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select(
        key.cast("string").alias("store_id"), F.concat(F.lit(" "), F.col("s_name"), F.lit(" ")).alias("name"), F.col("n_name").alias("chain"), lat.alias("lat"), (F.lit(-9.0) - (key % 37) / F.lit(100.0)).alias("lon"), F.lit(NOW).alias("ingested_at"),
    )


def raw_products(spark: SparkSession, d: str) -> DataFrame:
    """part as product records: two versions of every fourth, some without name, in several languages, with amounts and categories, one unknown."""
    k = F.col("p_partkey")
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (k % len(values) + 1).cast("int"))
    first = table(spark, d, "part").select(
        code("p_partkey").alias("barcode"), F.when(k % 17 == 0, F.lit("")).when(k % 19 == 0, F.concat(F.lit("café "), F.col("p_name"))).when(k % 7 == 0, F.concat(F.lit("oat  "), F.col("p_name"))).otherwise(F.col("p_name")).alias("product_name"),
        F.when(k % 5 != 0, F.col("p_brand")).alias("brands"), F.col("p_type").alias("categories_tags"), F.concat(F.col("p_size").cast("string"), F.lit(".5 "), pick(UNITS)).alias("quantity"),
        F.when(k % 6 == 0, F.lit("fr")).when(k % 6 == 1, F.lit("")).when(k % 6 == 2, F.lit("en")).alias("lang"), (k * 10).cast("long").alias("last_modified_t"), pick([*KEYS, "unknown"]).alias("taxonomy_key"), F.lit(NOW).alias("ingested_at"),
    )
    second = first.where(F.col("last_modified_t") % 40 == 0).withColumns({"product_name": F.concat("product_name", F.lit(" new")), "last_modified_t": F.col("last_modified_t") + 5})
    return first.unionByName(second)


def messages(spark: SparkSession, d: str) -> DataFrame:
    """events as price-event messages: both versions, bad prices, missing fields, malformed text."""
    k = F.col("event_id")
    shared = [k.alias("event_id"), (F.col("user_id") % 50).cast("int").alias("store_id"), (k % 97).cast("int").alias("product_id"), F.when(k % 16 == 3, -F.col("value")).otherwise(F.col("value") + 1).alias("price"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("observed_at")]
    one = F.to_json(F.struct(F.lit(1).alias("schema_version"), *shared))
    two = F.to_json(F.struct(F.lit(2).alias("schema_version"), *shared, (k % 9 != 0).alias("in_stock"), F.lit("EUR").alias("currency")))
    value = F.when(k % 50 == 7, F.lit("{not json")).when(k % 50 == 8, F.lit('{"schema_version": 1, "event_id": 1}')).when(k % 50 == 9, F.lit('{"schema_version": 99}')).when(k % 10 == 0, one).otherwise(two)
    return table(spark, d, "events").select(k.alias("offset"), value.alias("value"))


def products(spark: SparkSession, d: str) -> DataFrame:
    return medallion.dim_product(raw_products(spark, d), medallion.category_map(spark))


def stores(spark: SparkSession, d: str) -> DataFrame:
    return medallion.dim_store(raw_stores(spark, d))


def inventory(spark: SparkSession, d: str) -> DataFrame:
    return medallion.fact_inventory(price_events(spark, d))


def offers(spark: SparkSession, d: str) -> DataFrame:
    return medallion.offers(inventory(spark, d), stores(spark, d), products(spark, d))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder for a table: in the cluster's shared checkpoint folder, else in the warehouse."""
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the cluster shares")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/millrace-tables/{name}-{uuid.uuid4().hex}"


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _round(x: str, digits: int = 2) -> str:
    scale = f"{10**digits}.0::DOUBLE"
    return f"floor(({x}) * {scale} + 0.5::DOUBLE) / {scale}"


ROUND = _round
CTE = {
    "price_events": """price_events AS (SELECT lpad(l_orderkey::VARCHAR, 12, '0') || lpad(l_linenumber::VARCHAR, 4, '0') AS event_id, l_suppkey::VARCHAR AS store_id,
  lpad(l_partkey::VARCHAR, 12, '0') AS barcode, l_extendedprice / l_quantity AS price, l_returnflag <> 'R' AS in_stock,
  strftime(l_shipdate, '%Y-%m-%dT%H:%M:%S') AS observed_at, strftime(l_shipdate, '%Y-%m-%d') AS event_date FROM lineitem)""",
    "raw_stores": f"""raw_stores AS (SELECT s_suppkey::VARCHAR AS store_id, ' ' || s_name || ' ' AS name, n_name AS chain,
  CASE WHEN s_suppkey % 11 <> 0 THEN 38.0::DOUBLE + (s_suppkey % 100) / 100.0::DOUBLE END AS lat, -9.0::DOUBLE - (s_suppkey % 37) / 100.0::DOUBLE AS lon, '{NOW}' AS ingested_at
  FROM supplier JOIN nation ON s_nationkey = n_nationkey)""",
    "raw_products": f"""first_products AS (SELECT lpad(p_partkey::VARCHAR, 12, '0') AS barcode,
  CASE WHEN p_partkey % 17 = 0 THEN '' WHEN p_partkey % 19 = 0 THEN 'café ' || p_name WHEN p_partkey % 7 = 0 THEN 'oat  ' || p_name ELSE p_name END AS product_name,
  CASE WHEN p_partkey % 5 <> 0 THEN p_brand END AS brands, p_type AS categories_tags, p_size::VARCHAR || '.5 ' || ({_list(UNITS)})[p_partkey % {len(UNITS)} + 1] AS quantity,
  CASE WHEN p_partkey % 6 = 0 THEN 'fr' WHEN p_partkey % 6 = 1 THEN '' WHEN p_partkey % 6 = 2 THEN 'en' END AS lang, p_partkey * 10 AS last_modified_t,
  ({_list([*KEYS, 'unknown'])})[p_partkey % {len(KEYS) + 1} + 1] AS taxonomy_key, '{NOW}' AS ingested_at FROM part),
raw_products AS (SELECT * FROM first_products UNION ALL
  SELECT barcode, product_name || ' new', brands, categories_tags, quantity, lang, last_modified_t + 5, taxonomy_key, ingested_at FROM first_products WHERE last_modified_t % 40 = 0)""",
    "category_map": "category_map(taxonomy_key, product_group, term, base_price, exclude) AS (VALUES " + ", ".join(f"('{k}', '{g}', '{t}', {p}::DOUBLE, {_list(x)}::VARCHAR[])" for k, g, t, p, x in TAXONOMY) + ")",
    "inventory": """inventory AS (SELECT store_id || '|' || barcode AS inv_key, store_id, barcode, price, in_stock, observed_at FROM price_events
  QUALIFY row_number() OVER (PARTITION BY store_id, barcode ORDER BY observed_at DESC, event_id DESC, price DESC, in_stock DESC) = 1)""",
    "stores": "stores AS (SELECT store_id, trim(name) AS name, trim(chain) AS chain, lat, lon FROM raw_stores WHERE lat IS NOT NULL AND lon IS NOT NULL)",
    "latest_products": """latest_products AS (SELECT trim(barcode) AS barcode, trim(product_name) AS product_name, brands, categories_tags, quantity, lang, last_modified_t, taxonomy_key, ingested_at
  FROM raw_products WHERE length(trim(barcode)) > 0 AND length(trim(product_name)) > 0
  QUALIFY row_number() OVER (PARTITION BY trim(barcode) ORDER BY last_modified_t DESC, ingested_at DESC) = 1)""",
}
QUANTITY_VALUE = "regexp_extract(lower(quantity), '(\\d+(?:\\.\\d+)?)\\s*(fl\\s*oz|floz|kg|mg|cl|ml|oz|lb|g|l)\\b', {})"
FACTOR = "CASE {} WHEN 'kg' THEN 1000.0 WHEN 'g' THEN 1.0 WHEN 'mg' THEN 0.001 WHEN 'l' THEN 1000.0 WHEN 'ml' THEN 1.0 WHEN 'cl' THEN 10.0 WHEN 'oz' THEN 28.3495 WHEN 'lb' THEN 453.592 WHEN 'floz' THEN 29.5735 END::DOUBLE"
UNIT = f"replace({QUANTITY_VALUE.format(2)}, ' ', '')"
SIZE_VALUE = _round(f"try_cast({QUANTITY_VALUE.format(1)} AS DOUBLE) * {FACTOR.format(UNIT)}")
SIZE_UNIT = f"CASE WHEN {UNIT} IN ('kg', 'g', 'mg', 'oz', 'lb') THEN 'g' WHEN {UNIT} IN ('l', 'ml', 'cl', 'floz') THEN 'ml' END"
BASE_PRICE = _round("base_price * (0.85::DOUBLE + (coalesce(try_cast(right(regexp_replace(barcode, '[^0-9]', '', 'g'), 4) AS INTEGER), 0) % 31) / 100.0::DOUBLE)")
TOKENS = "list_filter(regexp_extract_all(lower(product_name || ' ' || coalesce(brands, '')), '[a-z0-9]+'), lambda t: length(t) > 1 AND t <> term)"
ORDERED = "(SELECT list(t ORDER BY i) FROM (SELECT t, min(i) AS i FROM (SELECT unnest({0}) AS t, generate_subscripts({0}, 1) AS i) GROUP BY t))"
TERMS = f"(CASE WHEN len(list_filter(exclude, lambda x: contains(lower(product_name), x))) > 0 THEN []::VARCHAR[] ELSE [term] END || {TOKENS})"
CTE["products"] = f"""squeezed AS (SELECT l.* EXCLUDE (product_name), trim(regexp_replace(product_name, '\\s+', ' ', 'g')) AS product_name, c.* EXCLUDE (taxonomy_key)
  FROM latest_products l JOIN category_map c USING (taxonomy_key) WHERE (lang IS NULL OR lang IN ('en', '')) AND NOT regexp_matches(product_name, '[^\\x00-\\x7F]')),
products AS (SELECT barcode, product_name, coalesce(brands, '') AS brands, taxonomy_key AS category, product_group, {SIZE_VALUE} AS size_value, {SIZE_UNIT} AS size_unit,
  {BASE_PRICE} AS base_price, array_to_string(list_filter({TERMS}, lambda t, i: list_position({TERMS}, t) = i)[1:10], '|') AS search_terms, categories_tags, last_modified_t FROM squeezed)"""
CTE["offers"] = """offers AS (SELECT i.store_id, s.name AS store_name, s.chain, s.lat, s.lon, p.barcode AS product_id, p.product_name, p.category, coalesce(p.size_unit, 'each') AS unit,
  p.search_terms, i.price, i.in_stock FROM inventory i JOIN stores s ON i.store_id = s.store_id JOIN products p ON i.barcode = p.barcode)"""
NEEDS = {"inventory": ["price_events"], "stores": ["raw_stores"], "latest_products": ["raw_products"], "products": ["latest_products", "category_map"], "offers": ["inventory", "stores", "products"]}


def sql(body: str, *needed: str) -> str:
    """The body after the relations it needs."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in NEEDS.get(name, ()):
            add(x)
        if name not in order:
            order.append(name)

    for n in needed:
        add(n)
    return f"WITH {', '.join(CTE[n] for n in order)}\n{body}" if order else body
