"""Queries over the driver's tables, by inventory id, and the same in SQL."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from millrace.functions import embed, events, fuzzy, geo, gtin, price, text
from millrace.operators import matching, medallion, pipeline, planner, quality, runs, schema
from millrace.operators.tables import LakeTable, first_of_key
from millrace.plans import tables as t
from millrace.plans.tables import ROUND, sql
from millrace.session import table
from millrace.sources import files, generators
from millrace.streaming import jobs, routing

QUERIES: dict = {}
ORACLES: dict = {}
RUN, NOW, SOURCE = "run1", t.NOW, "openfoodfacts"
CENTRE = generators.CENTRE


def query(body: str | None = None, *needed: str):
    """Registers a function by its name, with its SQL where SQL can say the same."""

    def register(f):
        QUERIES[f.__name__] = f
        if body is not None:
            ORACLES[f.__name__] = sql(body, *needed)
        return f

    return register


# Staging and filters


@query("SELECT trim(barcode) AS barcode, trim(product_name) AS product_name, brands, categories_tags, quantity, lang, last_modified_t, taxonomy_key, ingested_at FROM raw_products", "raw_products")
def p1_stage_products(spark, d):
    return medallion.stage_products(t.raw_products(spark, d))


@query("SELECT store_id, trim(name) AS name, trim(chain) AS chain, lat, lon, ingested_at FROM raw_stores", "raw_stores")
def p2_stage_stores(spark, d):
    return medallion.stage_stores(t.raw_stores(spark, d))


@query("SELECT event_id, store_id, barcode, price, in_stock, observed_at FROM price_events", "price_events")
def p3_stage_price_events(spark, d):
    return medallion.stage_price_events(t.price_events(spark, d))


@query("SELECT barcode AS product_id, product_name, brands, category, product_group, size_value, size_unit, base_price, search_terms FROM products", "products")
def p4_product_catalog(spark, d):
    return medallion.product_catalog(t.products(spark, d))


@query("SELECT barcode, product_name FROM raw_products WHERE length(barcode) > 0 AND length(product_name) > 0", "raw_products")
def p5_filled(spark, d):
    return t.raw_products(spark, d).where(medallion.filled("barcode", "product_name")).select("barcode", "product_name")


@query("SELECT barcode, taxonomy_key FROM raw_products WHERE taxonomy_key IN (SELECT taxonomy_key FROM category_map)", "raw_products", "category_map")
def p6_known_keys(spark, d):
    return t.raw_products(spark, d).join(F.broadcast(medallion.category_map(spark)), "taxonomy_key", "left_semi").select("barcode", "taxonomy_key")


@query("SELECT barcode, lang FROM raw_products WHERE lang IS NULL OR lang IN ('en', '')", "raw_products")
def p7_language(spark, d):
    return t.raw_products(spark, d).where(F.col("lang").isNull() | F.col("lang").isin("en", "")).select("barcode", "lang")


@query("SELECT doc_id, NOT regexp_matches(text, '[^\\x00-\\x7F]') AS ascii FROM documents")
def p8_ascii(spark, d):
    return table(spark, d, "documents").select("doc_id", text.is_ascii(F.col("text")).alias("ascii"))


@query("SELECT * FROM stores", "stores")
def p9_w3_dim_store(spark, d):
    return t.stores(spark, d)


@query("SELECT store_id, product_id, price FROM offers WHERE in_stock", "offers")
def p10_in_stock(spark, d):
    return t.offers(spark, d).where("in_stock").select("store_id", "product_id", "price")


@query(f"SELECT '{RUN}' AS run_id, barcode, product_name, taxonomy_key, CASE WHEN length(barcode) = 0 THEN 'missing_barcode' ELSE 'missing_name' END AS quarantine_reason, '{NOW}' AS quarantined_at FROM raw_products WHERE length(barcode) = 0 OR length(product_name) = 0", "raw_products")
def p11_quarantine(spark, d):
    return quality.quarantine(t.raw_products(spark, d), RUN, NOW)


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NULL OR c_acctbal <= 0 OR c_acctbal > 1000")
def p12_bad_prices(spark, d):
    return table(spark, d, "customer").where(quality.bad_price(F.col("c_acctbal"))).select("c_custkey", "c_acctbal")


@query("SELECT event_id, price FROM price_events WHERE event_date = '1995-06-17'", "price_events")
def p13_one_day(spark, d):
    return t.price_events(spark, d, "1995-06-17").select("event_id", "price")


@query("SELECT barcode, taxonomy_key, last_modified_t FROM raw_products WHERE last_modified_t > CASE taxonomy_key WHEN 'milk' THEN 5000 WHEN 'rice' THEN 800 ELSE 0 END", "raw_products")
def p14_since_watermark(spark, d):
    marks = spark.createDataFrame([("milk", 5000), ("rice", 800)], "category string, watermark_ts long")
    return runs.since(t.raw_products(spark, d), marks).select("barcode", "taxonomy_key", "last_modified_t")


@query("SELECT o_orderkey, o_orderdate, o_orderstatus FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def p15_latest_run(spark, d):
    orders = table(spark, d, "orders")
    last = orders.agg(F.max("o_orderdate").alias("o_orderdate"))
    return orders.join(F.broadcast(last), "o_orderdate", "left_semi").select("o_orderkey", "o_orderdate", "o_orderstatus")


@query("SELECT barcode, category, base_price FROM products WHERE category IN ('milk', 'rice', 'eggs')", "products")
def p20_categories(spark, d):
    return t.products(spark, d).where(F.col("category").isin("milk", "rice", "eggs")).select("barcode", "category", "base_price")


# Joins


@query("SELECT * FROM offers", "offers")
def j1_j2_offers(spark, d):
    return t.offers(spark, d)


@query("SELECT r.barcode, c.term, c.product_group FROM raw_products r JOIN category_map c USING (taxonomy_key)", "raw_products", "category_map")
def j3_categories(spark, d):
    return t.raw_products(spark, d).join(F.broadcast(medallion.category_map(spark)), "taxonomy_key").select("barcode", "term", "product_group")


@query("SELECT l_orderkey, l_partkey FROM lineitem WHERE l_partkey IS NOT NULL AND l_partkey NOT IN (SELECT p_partkey FROM part WHERE p_size > 10)")
def j7_relationships(spark, d):
    parents = table(spark, d, "part").where("p_size > 10")
    return quality.relationships(table(spark, d, "lineitem"), "l_partkey", parents, "p_partkey").select("l_orderkey", "l_partkey")


PAIRS = (("supplier", "customer"), ("customer", "supplier"), ("labels", "conversations"), ("conversations", "labels"), ("orders", "lineitem"))
# The tables' columns by their meaning, so that two tables have some in common.
MEANING = {"doc_id": "id", "conv_id": "id", "quality": "turn"}
TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "TIMESTAMP": "timestamp_ntz"}
KINDS = "CASE data_type " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in TYPES.items()) + " END"


@query(f"""WITH c AS (SELECT DISTINCT table_name AS t, CASE column_name {' '.join(f"WHEN '{a}' THEN '{b}'" for a, b in MEANING.items())} ELSE regexp_replace(column_name, '^[a-z]_', '') END AS path, {KINDS} AS kind FROM duckdb_columns()),
p(old, new) AS (VALUES {', '.join(map(str, PAIRS))})
SELECT pair, path, CASE WHEN actual IS NULL THEN 'removed_column' WHEN expected IS NULL THEN 'added_column' WHEN expected = 'int' AND actual = 'bigint' THEN 'widened_type' WHEN expected = 'bigint' AND actual = 'int' THEN 'narrowed_type' ELSE 'changed_type' END AS change,
  expected, actual, CASE WHEN expected IS NULL OR (expected = 'int' AND actual = 'bigint') THEN 'info' ELSE 'error' END AS severity
FROM (SELECT old || ' ' || new AS pair, path, max(CASE WHEN t = old THEN kind END) AS expected, max(CASE WHEN t = new THEN kind END) AS actual FROM p JOIN c ON t IN (old, new) GROUP BY old, new, path) WHERE expected IS DISTINCT FROM actual""")
def j10_drift(spark, d):
    """Structural drift between given tables, by the meaning of their columns."""
    named = lambda name: (rows := table(spark, d, name)).select(*[F.col(c).alias(MEANING.get(c) or re.sub("^[a-z]_", "", c)) for c in rows.columns]).schema
    return reduce(DataFrame.unionByName, [schema.drift(spark, named(old), named(new)).withColumn("pair", F.lit(f"{old} {new}")) for old, new in PAIRS])


# Aggregates

STATS = f"""SELECT category, count(DISTINCT product_id) AS num_products, count(*) AS num_offers, {ROUND('min(price)')} AS min_price, {ROUND('avg(price)')} AS avg_price,
  {ROUND('max(price)')} AS max_price, arg_min(store_name, {{'p': price, 'n': store_name}}) AS cheapest_store FROM offers WHERE in_stock GROUP BY category"""


@query(STATS, "offers")
def a1_category_stats(spark, d):
    return medallion.category_price_stats(t.offers(spark, d))


@query(f"SELECT product_id, min(product_name) AS product_name, min(category) AS category, min(search_terms) AS search_terms, count(*) FILTER (in_stock) AS num_stores_in_stock, {ROUND('min(price)')} AS min_price FROM offers GROUP BY product_id", "offers")
def a2_search_index(spark, d):
    return medallion.product_search_index(t.offers(spark, d))


@query(f"SELECT count(*) AS n, {ROUND('avg(l_extendedprice)', 3)} AS avg_price FROM lineitem")
def a3_global(spark, d):
    return table(spark, d, "lineitem").agg(F.count("*").alias("n"), text.half_up(F.avg("l_extendedprice"), 3).alias("avg_price"))


@query(f"SELECT '{SOURCE}|' || taxonomy_key AS wm_key, '{SOURCE}' AS source, taxonomy_key AS category, max(coalesce(last_modified_t, 0)) AS watermark_ts, '{NOW}' AS updated_at FROM raw_products GROUP BY taxonomy_key", "raw_products")
def a4_m2_watermarks(spark, d):
    return runs.watermarks(t.raw_products(spark, d), SOURCE, NOW)


@query("SELECT count(*) AS n FROM raw_products WHERE coalesce(length(barcode), 0) = 0 OR coalesce(length(product_name), 0) = 0", "raw_products")
def a5_rejected(spark, d):
    return runs.rejected(t.raw_products(spark, d))


@query("SELECT count(*) - count(DISTINCT l_orderkey) AS failed_count, count(*) AS total_count FROM lineitem")
def a6_duplicates(spark, d):
    return quality.duplicates(table(spark, d, "lineitem"), "l_orderkey")


GTIN = "(10 - list_sum(list_transform(range(1, 14), lambda i: substring(lpad({0}, 14, '0'), i::INT, 1)::INT * CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END)) % 10) % 10 = substring(lpad({0}, 14, '0'), 14, 1)::INT"
CHECKS = [
    ("malformed_records", "bronze", "raw_products", "warn", "SELECT count(*) FILTER (length(barcode) = 0 OR length(product_name) = 0) AS f, count(*) AS n FROM raw_products", "empty barcode or product_name"),
    ("duplicate_products", "silver", "dim_product", "error", "SELECT count(*) - count(DISTINCT barcode) AS f, count(*) AS n FROM products", "barcode must be unique"),
    ("missing_categories", "silver", "dim_product", "error", "SELECT count(*) FILTER (category IS NULL OR category = '') AS f, count(*) AS n FROM products", "category must be set"),
    ("invalid_upcs", "silver", "dim_product", "warn", f"SELECT count(*) FILTER (NOT {GTIN.format('barcode')}) AS f, count(*) AS n FROM products", "GTIN check digit failed"),
    ("invalid_prices", "gold", "store_product_offers", "error", "SELECT count(*) FILTER (price IS NULL OR price <= 0 OR price > 1000) AS f, count(*) AS n FROM offers", "price must be in (0, 1000]"),
]
CHECK_SQL = " UNION ALL ".join(f"""SELECT '{RUN}' AS run_id, '{n}' AS check_name, '{l}' AS layer, '{tb}' AS "table", '{s}' AS severity, f AS failed_count, n AS total_count, f = 0 AS passed, '{dt}' AS detail, '{NOW}' AS checked_at FROM ({q})""" for n, l, tb, s, q, dt in CHECKS)


def _checks(spark, d):
    return quality.run_checks(t.raw_products(spark, d), t.products(spark, d), t.offers(spark, d), RUN, NOW)


@query(CHECK_SQL, "raw_products", "offers")
def a7_q1_q6_checks(spark, d):
    return _checks(spark, d)


@query(f"SELECT count(*) FILTER (severity = 'error' AND NOT passed) AS n FROM ({CHECK_SQL})", "raw_products", "offers")
def a16_q8_hard_failures(spark, d):
    return quality.hard_failures(_checks(spark, d))


COUNTS = ["customer", "lineitem", "orders", "part", "supplier"]


@query(" UNION ALL ".join(f"SELECT '{RUN}' AS run_id, 'row_count' AS metric, '{n}' AS target, count(*)::DOUBLE AS value, '{NOW}' AS captured_at FROM {n}" for n in COUNTS))
def a8_m3_row_counts(spark, d):
    return runs.row_counts({n: table(spark, d, n) for n in COUNTS}, RUN, NOW)


@query(f"SELECT {ROUND('(2000000000 - max(last_modified_t)) / 3600.0::DOUBLE', 1)} AS hours FROM raw_products", "raw_products")
def a9_freshness(spark, d):
    return t.raw_products(spark, d).agg(runs.freshness_hours(F.max("last_modified_t"), 2_000_000_000).alias("hours"))


@query("SELECT max(o_totalprice) < 480000 AS fresh FROM orders WHERE o_orderdate = (SELECT max(o_orderdate) FROM orders)")
def a10_freshness_gate(spark, d):
    metrics = table(spark, d, "orders").select(F.lit("freshness_hours").alias("metric"), F.col("o_orderdate").alias("run_id"), F.col("o_orderdate").alias("captured_at"), F.col("o_totalprice").alias("value"))
    return runs.is_fresh(metrics, 480000)


@query("SELECT event_date AS \"partition\", 1::BIGINT AS files FROM (SELECT DISTINCT 'event_date=' || strftime(ts, '%Y-%m-%d') AS event_date FROM events)")
def a11_k10_compacted_files(spark, d):
    """Appends in small batches, then one file for each day."""
    lake = LakeTable(spark, t.scratch(spark, "events"))
    rows = table(spark, d, "events").select("event_id", "value", F.date_format("ts", "yyyy-MM-dd").alias("event_date"))
    for k in range(3):  # every row is in one of the batches
        lake.write(rows.where(F.col("event_id") % 3 == k), "append", ["event_date"])
    lake.compact()
    return lake.files_by_partition()


@query("SELECT CASE WHEN event_id % 50 IN (7, 8, 9) OR (event_id % 16 = 3 AND -value <= 0) OR (event_id % 16 <> 3 AND value + 1 <= 0) THEN 'dlq' ELSE 'ok' END AS route, count(*) AS n FROM events GROUP BY 1")
def a17_t1_route_counts(spark, d):
    return routing.counts(routing.route(t.messages(spark, d)))


# Windows


@query("SELECT * FROM latest_products", "latest_products")
def w1_latest_product(spark, d):
    return medallion.latest(medallion.stage_products(t.raw_products(spark, d)).where(medallion.filled("barcode", "product_name")), ["barcode"], ["last_modified_t", "ingested_at"])


@query("SELECT * FROM inventory", "inventory")
def w2_latest_price(spark, d):
    return t.inventory(spark, d)


@query(f"SELECT product_id, product_name, category, {ROUND('price')} AS cheapest_price, store_name AS cheapest_store FROM offers WHERE in_stock QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) = 1", "offers")
def w4_cheapest(spark, d):
    return medallion.cheapest_products(t.offers(spark, d))


@query("SELECT event_id, coalesce(top > 0 AND s < top - 3600, false) AS late FROM (SELECT event_id, s, max(s) OVER (ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM (SELECT event_id, epoch(ts) AS s, (event_id * 7919) % 1000003 AS o FROM events))")
def w5_t4_late_flags(spark, d):
    rows = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1e6)).alias("s"), (F.col("event_id") * 7919 % 1000003).alias("o"))
    return routing.late_in_order(rows, "o", seconds=F.col("s"), ties=["event_id"]).select("event_id", F.col("_late").alias("late"))


# Sorts, limits, sets


@query("SELECT category, min_price FROM (" + STATS + ") ORDER BY category", "offers")
def o1_stats_by_category(spark, d):
    return medallion.category_price_stats(t.offers(spark, d)).select("category", "min_price").orderBy("category")


CHEAPEST = f"SELECT product_id, product_name, category, {ROUND('price')} AS cheapest_price, store_name AS cheapest_store FROM offers WHERE in_stock QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) = 1"


@query(f"SELECT product_id, category, cheapest_price FROM ({CHEAPEST}) ORDER BY category, cheapest_price, product_id", "offers")
def o2_cheapest_by_category(spark, d):
    return medallion.cheapest_products(t.offers(spark, d)).select("product_id", "category", "cheapest_price").orderBy("category", "cheapest_price", "product_id")


HAVERSINE = "2 * 6371.0::DOUBLE * asin(sqrt(least(pow(sin(radians({c} - {a}) / 2), 2) + cos(radians({a})) * cos(radians({c})) * pow(sin(radians({d} - {b}) / 2), 2), 1.0)))"
KM = HAVERSINE.format(a=f"{CENTRE[0]}::DOUBLE", b=f"({CENTRE[1]}::DOUBLE)", c="lat", d="lon")


def _near(spark, d) -> DataFrame:
    return t.stores(spark, d).withColumn("km", geo.haversine_km(F.lit(CENTRE[0]), F.lit(CENTRE[1]), F.col("lat"), F.col("lon")))


@query(f"SELECT store_id, {ROUND(KM, 4)} AS km FROM stores ORDER BY 2, 1", "stores")
def o3_x8_stores_by_distance(spark, d):
    return _near(spark, d).select("store_id", text.half_up(F.col("km"), 4).alias("km")).orderBy("km", "store_id")


@query("SELECT store_id, product_id, price FROM offers WHERE in_stock QUALIFY row_number() OVER (PARTITION BY store_id ORDER BY price, product_id) <= 5", "offers")
def o9_store_cap(spark, d):
    from pyspark.sql import Window

    rank = F.row_number().over(Window.partitionBy("store_id").orderBy("price", "product_id"))
    return t.offers(spark, d).where("in_stock").withColumn("n", rank).where("n <= 5").select("store_id", "product_id", "price")


@query()
def o8_seeded_order(spark, d):
    return table(spark, d, "part").select("p_partkey").orderBy(F.xxhash64("p_partkey", F.lit(42)), "p_partkey")


@query("SELECT count(*) AS n, count(DISTINCT p_partkey) AS n_keys, sum(p_partkey)::BIGINT AS total, true AS shuffled FROM part")
def o8_order_is_a_permutation(spark, d):
    """All rows once, and not in the order of their keys."""
    rows = o8_seeded_order(spark, d).withColumn("place", F.monotonically_increasing_id()).agg(F.count("*").alias("n"), F.countDistinct("p_partkey").alias("n_keys"), F.sum("p_partkey").alias("total"), F.corr("place", F.col("p_partkey").cast("double")).alias("c"))
    return rows.select("n", "n_keys", "total", (F.abs("c") < 0.5).alias("shuffled"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 6")
def o10_head(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(6)


@query("SELECT c_nationkey AS nation FROM customer UNION ALL SELECT s_nationkey FROM supplier")
def u1_append(spark, d):
    return reduce(DataFrame.unionByName, [table(spark, d, "customer").select(F.col("c_nationkey").alias("nation")), table(spark, d, "supplier").select(F.col("s_nationkey").alias("nation"))])


@query("SELECT o_custkey FROM orders EXCEPT SELECT c_custkey FROM customer WHERE c_acctbal > 0")
def u2_difference(spark, d):
    return table(spark, d, "orders").select("o_custkey").subtract(table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey"))


@query("SELECT l_orderkey, list_sort(list(DISTINCT l_suppkey)) AS stores FROM lineitem GROUP BY l_orderkey")
def u3_distinct_stores(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_set("l_suppkey")).alias("stores"))


@query("SELECT o_custkey, min(o_orderkey) AS o_orderkey FROM orders GROUP BY o_custkey")
def u5_one_a_key(spark, d):
    return first_of_key(table(spark, d, "orders").select("o_custkey", "o_orderkey"), ["o_custkey"], [F.asc("o_orderkey")])


# Kernels


@query(f"SELECT barcode, last_modified_t, {t.SIZE_VALUE} AS size_value, {t.SIZE_UNIT} AS size_unit FROM raw_products", "raw_products")
def x1_quantity(spark, d):
    q = F.col("quantity")
    return t.raw_products(spark, d).select("barcode", "last_modified_t", text.quantity_value(q).alias("size_value"), text.quantity_unit(q).alias("size_unit"))


@query(f"SELECT barcode, p_retailprice, {t.BASE_PRICE} AS base FROM (SELECT lpad(p_partkey::VARCHAR, 12, '0') AS barcode, p_retailprice, p_retailprice AS base_price FROM part)")
def x2_base_price(spark, d):
    return table(spark, d, "part").select(t.code("p_partkey").alias("barcode"), "p_retailprice").withColumn("base", price.base_price(F.col("p_retailprice"), F.col("barcode")))


@query("SELECT barcode, search_terms FROM products", "products")
def x3_search_terms(spark, d):
    return t.products(spark, d).select("barcode", "search_terms")


PLAIN = "NOT (taxonomy_key = 'milk' AND (lower(product_name) LIKE '%almond%' OR lower(product_name) LIKE '%oat%' OR lower(product_name) LIKE '%soy%' OR lower(product_name) LIKE '%coconut%'))"


@query(f"SELECT barcode, last_modified_t, CASE WHEN {PLAIN} THEN term || '|' || w ELSE w END AS terms FROM (SELECT *, lower(regexp_replace(trim(product_name), '\\s+', '|', 'g')) AS w FROM raw_products JOIN category_map USING (taxonomy_key))", "raw_products", "category_map")
def x4_p17_raw_terms(spark, d):
    rows = t.raw_products(spark, d).join(F.broadcast(medallion.category_map(spark)), "taxonomy_key")
    plain = ~((F.col("taxonomy_key") == "milk") & F.lower("product_name").rlike("almond|oat|soy|coconut"))
    return rows.select("barcode", "last_modified_t", text.raw_terms(F.col("product_name"), F.col("term"), plain).alias("terms"))


@query("SELECT page_id, md5(trim(regexp_replace(html, '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))) AS digest FROM pages")
def x5_squeeze(spark, d):
    return table(spark, d, "pages").select("page_id", F.md5(text.squeeze(F.col("html"))).alias("digest"))


CODES = "SELECT c_custkey, lpad((c_custkey * 7919)::VARCHAR, CASE c_custkey % 5 WHEN 0 THEN 8 WHEN 1 THEN 12 WHEN 2 THEN 13 WHEN 3 THEN 14 ELSE 10 END, '0') AS code FROM customer"


def _codes(spark, d):
    size = F.when(F.col("c_custkey") % 5 == 0, 8).when(F.col("c_custkey") % 5 == 1, 12).when(F.col("c_custkey") % 5 == 2, 13).when(F.col("c_custkey") % 5 == 3, 14).otherwise(10)
    return table(spark, d, "customer").select("c_custkey", F.lpad((F.col("c_custkey") * 7919).cast("string"), size, F.lit("0")).alias("code"))


@query(f"SELECT c_custkey, length(code) IN (8, 12, 13, 14) AND {GTIN.format('code')} AS valid, length(code) IN (8, 12, 13, 14) AS shaped FROM ({CODES})")
def x6_x7_gtin(spark, d):
    return _codes(spark, d).select("c_custkey", gtin.valid_gtin(F.col("code")).alias("valid"), gtin.has_gtin_length(F.col("code")).alias("shaped"))


LCS = """list_last(list_reduce(string_split(a, ''), lambda row, c: list_reduce(range(1, length(b) + 1), lambda acc, j:
  list_append(acc, CASE WHEN substring(b, j::INT, 1) = c THEN row[j::INT] + 1 ELSE greatest(row[j::INT + 1], list_last(acc)) END), [0::BIGINT]), list_transform(range(0, length(b) + 1), lambda x: 0::BIGINT)))"""
SORTED = "array_to_string(list_sort(list_filter(regexp_split_to_array(lower({}), '\\s+'), lambda x: x <> '')), ' ')"
NAMES = "SELECT DISTINCT p_name AS name FROM part"


def _names(spark, d):
    return table(spark, d, "part").select(F.col("p_name").alias("name")).distinct().withColumn("query", F.lit("rice milk"))


@query(f"SELECT name, {ROUND(f'2.0::DOUBLE * {LCS} / (length(a) + length(b))', 6)} AS ratio FROM (SELECT name, {SORTED.format('name')} AS a, {SORTED.format(chr(39) + 'rice milk' + chr(39))} AS b FROM ({NAMES}))")
def x10_token_sort_ratio(spark, d):
    return _names(spark, d).select("name", text.half_up(fuzzy.token_sort_ratio(F.lower("name"), F.col("query")), 6).alias("ratio"))


@query(ORACLES["x10_token_sort_ratio"])
def x10_token_sort_ratio_arrow(spark, d):
    return _names(spark, d).select("name", text.half_up(fuzzy.token_sort_ratio_arrow(F.lower("name"), F.col("query")), 6).alias("ratio"))


@query()
def x11_x14_embedding(spark, d):
    return _names(spark, d).select("name", embed.ngram_embedding(F.col("name"), 64).alias("embedding"))


@query(f"SELECT name, 64 AS size, 1.0::DOUBLE AS norm, 1.0::DOUBLE AS own FROM ({NAMES})")
def x11_embedding_norms(spark, d):
    """Embeddings have length one, and the same text the same one, in lower case or not."""
    rows = _names(spark, d).select("name", embed.ngram_embedding(F.col("name"), 64).alias("e"), embed.ngram_embedding(F.upper("name"), 64).alias("u"))
    norm = F.sqrt(F.aggregate("e", F.lit(0.0), lambda a, x: a + x * x))
    return rows.select("name", F.size("e").alias("size"), text.half_up(norm, 6).alias("norm"), text.half_up(embed.cosine(F.col("e"), F.col("u")), 6).alias("own"))


@query(f"SELECT e.vec_id, {ROUND('list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])', 6)} AS cosine FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q")
def x13_cosine(spark, d):
    rows = table(spark, d, "embeddings")
    probe = rows.where("vec_id = 0").select(F.col("embedding").alias("q"))
    return rows.crossJoin(F.broadcast(probe)).select("vec_id", text.half_up(embed.cosine(F.col("embedding"), F.col("q")), 6).alias("cosine"))


@query("SELECT barcode, product_name || ' ' || search_terms AS candidate FROM products", "products")
def x15_candidate_text(spark, d):
    return t.products(spark, d).select("barcode", F.concat_ws(" ", "product_name", "search_terms").alias("candidate"))


@query("SELECT event_id, (props->>'$.k')::BIGINT AS k, '{\"event_id\":' || event_id || '}' AS body FROM events")
def x17_json(spark, d):
    rows = table(spark, d, "events")
    return rows.select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct("event_id")).alias("body"))


@query("SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, epoch(date_trunc('second', ts))::DOUBLE AS seconds FROM events")
def x18_x19_times(spark, d):
    stamp = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return table(spark, d, "events").select("event_id", events.event_date(stamp).alias("day"), events.event_seconds(stamp).alias("seconds"))


@query("SELECT barcode, list_filter(string_split(search_terms, '|'), lambda x: x <> '') AS terms FROM products", "products")
def x22_split_terms(spark, d):
    return t.products(spark, d).select("barcode", text.split_terms(F.col("search_terms")).alias("terms"))


@query("SELECT l_orderkey, array_to_string(list_sort(list(DISTINCT l_returnflag)), '|') AS tags FROM lineitem GROUP BY l_orderkey")
def x23_join_tags(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(text.join_tags(F.array_sort(F.collect_set("l_returnflag"))).alias("tags"))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE c_acctbal IS NULL OR c_acctbal <= 0")
def x25_q9_positive(spark, d):
    return quality.only_positive(table(spark, d, "customer"), "c_acctbal").select("c_custkey", "c_acctbal")


@query("SELECT o_custkey, count(*) AS n_records FROM orders GROUP BY o_custkey HAVING count(*) > 1")
def q9_unique(spark, d):
    return quality.unique(table(spark, d, "orders"), "o_custkey")


@query("SELECT barcode, taxonomy_key FROM raw_products WHERE lang IS NULL", "raw_products")
def q9_not_null(spark, d):
    return quality.not_null(t.raw_products(spark, d), "lang").select("barcode", "taxonomy_key")


@query("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus NOT IN ('O', 'F')")
def q9_accepted_values(spark, d):
    return quality.accepted_values(table(spark, d, "orders"), "o_orderstatus", ["O", "F"]).select("o_orderkey", "o_orderstatus")


# Table layer


def _orders(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


def _dearer(orders):
    return orders.withColumn("o_totalprice", F.col("o_totalprice") + 1)


MERGED = "SELECT o_orderkey, o_custkey, CASE WHEN {upd} THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice, o_orderstatus FROM orders"


@query(MERGED.format(upd="o_orderkey % 2 = 0"))
def k2_j4_upsert(spark, d):
    """All orders, then the even ones at another price, twice each."""
    lake, orders = LakeTable(spark, t.scratch(spark, "orders")), _orders(spark, d)
    lake.upsert(orders, "o_orderkey", partition_by=["o_orderstatus"])
    new = _dearer(orders.where("o_orderkey % 2 = 0"))
    lake.upsert(new.unionByName(new), "o_orderkey")
    return lake.read()


@query(MERGED.format(upd="o_orderkey % 3 = 0"))
def k3_j5_insert_new(spark, d):
    """Two thirds of the orders, then all at another price: the last third is new."""
    lake, orders = LakeTable(spark, t.scratch(spark, "orders")), _orders(spark, d)
    lake.insert_new(orders.where("o_orderkey % 3 <> 0"), "o_orderkey")
    lake.insert_new(_dearer(orders), "o_orderkey")
    return lake.read()


FEW = "o_orderkey IN (SELECT o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS n FROM orders) WHERE n <= 3)"


@query(f"SELECT *, 32::BIGINT AS n_files, true AS few_rewritten FROM ({MERGED.format(upd=FEW)})")
def k2_k9_merge_by_files(spark, d):
    """All orders in files by ranges of the key, then an upsert of a few: a file without such a key is carried over."""
    lake, orders = LakeTable(spark, t.scratch(spark, "orders")), _orders(spark, d)
    lake.write(orders.repartitionByRange(32, "o_orderkey"))
    n_files, version = lake.file_count(), lake.version()
    place = F.row_number().over(Window.partitionBy("o_orderstatus").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    few = orders.withColumn("n", place).where("n <= 3").drop("n")
    merged = lake.upsert(_dearer(few), "o_orderkey")
    touched = orders.join(few.select("o_orderkey"), "o_orderkey", "left_semi").count()
    return lake.read().withColumns({"n_files": F.lit(n_files).cast("long"), "few_rewritten": F.lit(0 < lake.rewritten(merged) <= touched and merged == version + 1)})


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders")
def s1_k13_time_travel(spark, d):
    lake = LakeTable(spark, t.scratch(spark, "orders"))
    old = _orders(spark, d)
    new = _dearer(old.where("o_orderkey % 2 = 0"))
    lake.write(old, "overwrite", ["o_orderstatus"])
    lake.upsert(new, "o_orderkey")
    return lake.read(version=0).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SELECT o_orderkey, o_custkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def s4_k4_k11_partition_read(spark, d):
    lake = LakeTable(spark, t.scratch(spark, "orders"))
    lake.write(_orders(spark, d), "overwrite", ["o_orderstatus"])
    lake.zorder(["o_custkey", "o_totalprice"], files=4)
    return lake.read().where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus")


@query("SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def s2_sql_on_frames(spark, d):
    return files.query(spark, "SELECT n_regionkey, count(*) AS n FROM {nations} GROUP BY n_regionkey", nations=table(spark, d, "nation"))


@query()
def s15_scale_events(spark, d):
    return generators.scale_events(spark, table(spark, d, "lineitem").count())


def simulate(spark: SparkSession, n_rows: int, n_days: int, n_batches: int) -> DataFrame:
    """A table of events appended in batches, one file a day and batch: rows of all days and of one, files before and after compaction, files that one day opens."""
    lake, day = LakeTable(spark, t.scratch(spark, "scale")), "2024-01-08"
    events = generators.scale_events(spark, n_rows, n_days)
    for k in range(n_batches):
        lake.write(events.where(F.col("event_id") % n_batches == k).repartition("event_date"), "append", ["event_date"])
    files = lake.compact()
    opened = lake.read().where(F.col("event_date") == day).select(F.input_file_name().alias("file")).groupBy("file").count()
    one = opened.agg(F.sum("count").alias("day_rows"), F.count("*").alias("day_files"))
    every = lake.read().agg(F.count("*").alias("n_rows"), F.countDistinct("event_date").alias("n_days"))
    return every.crossJoin(F.broadcast(one)).withColumns({"files_before": F.lit(files["before"]), "files_after": F.lit(files["after"])})


@query("SELECT n AS n_rows, 30::BIGINT AS n_days, (SELECT count(*) FROM range(0, n) AS r(i) WHERE i * 30 // n = 7) AS day_rows, 1::BIGINT AS day_files, 120 AS files_before, 30 AS files_after FROM (SELECT count(*) AS n FROM lineitem)")
def s15_k10_p13_scale_simulation(spark, d):
    return simulate(spark, table(spark, d, "lineitem").count(), 30, 4)


@query(f"SELECT * FROM (VALUES {', '.join(f'({chr(39)}{k}{chr(39)}, {chr(39)}{g}{chr(39)}, {chr(39)}{m}{chr(39)}, {p}::DOUBLE)' for k, g, m, p, _ in medallion.TAXONOMY)}) AS v(taxonomy_key, product_group, term, base_price)")
def s13_csv_seed(spark, d):
    path = t.scratch(spark, "seed")
    medallion.category_map(spark).select("taxonomy_key", "product_group", "term", "base_price").write.option("header", True).csv(path)
    return files.read_seed(spark, path)


LOG = "SELECT epoch_us(ts) // 1000 AS ts_ms, user_id::VARCHAR AS key, event_id::VARCHAR AS value FROM events"


@query(f"SELECT * FROM ({LOG}) WHERE ts_ms >= (SELECT (min(ts_ms) + max(ts_ms)) // 2 FROM ({LOG}))")
def s7_t11_replay_from(spark, d):
    log = table(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"))
    middle = log.agg(((F.min("ts_ms") + F.max("ts_ms")) / 2).cast("long")).first()[0]
    return files.replay_from(log, middle)


@query(f"SELECT * FROM ({LOG}) WHERE ts_ms >= (SELECT (min(ts_ms) + max(ts_ms)) // 2 FROM ({LOG})) ORDER BY ts_ms, key, value LIMIT 100")
def o11_limited_replay(spark, d):
    log = table(spark, d, "events").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("user_id").cast("string").alias("key"), F.col("event_id").cast("string").alias("value"))
    middle = log.agg(((F.min("ts_ms") + F.max("ts_ms")) / 2).cast("long")).first()[0]
    return files.replay_from(log, middle, 100)


@query("SELECT barcode, product_name, brands, last_modified_t, taxonomy_key FROM raw_products", "raw_products")
def s9_s10_json_source(spark, d):
    """Raw products written as files of one JSON array each, and read with the fixed schema."""
    path = t.scratch(spark, "json")
    rows = t.raw_products(spark, d).select("barcode", "product_name", "brands", "last_modified_t", "taxonomy_key")
    arrays = rows.groupBy(F.floor(F.col("barcode").cast("long") / 1000).alias("file")).agg(F.concat(F.lit("["), F.array_join(F.collect_list(F.to_json(F.struct("*"))), ","), F.lit("]")).alias("value"))
    arrays.repartition("file").write.partitionBy("file").text(path)
    return files.read_products_json(spark, path).select(*rows.columns)


# Runs

NEWER = "SELECT count(*) FROM part WHERE p_partkey % 4 = 0"
MALFORMED = "length(barcode) = 0 OR length(product_name) = 0"


def _lake(spark, d) -> pipeline.Lake:
    """A full run, then an incremental one, for which every fourth product has a newer record."""
    lake = pipeline.Lake(spark, t.scratch(spark, "lake"))
    raw = t.raw_products(spark, d).drop("ingested_at")
    newer = raw.where("last_modified_t % 40 = 0").withColumn("last_modified_t", F.col("last_modified_t") + 1_000_000_000)
    sources = pipeline.Sources(raw, t.raw_stores(spark, d), t.price_events(spark, d))
    pipeline.run(lake, sources, "full", "r1", "2024-01-01T00:00:00")
    pipeline.run(lake, pipeline.Sources(raw.unionByName(newer), sources.stores, sources.events), "incremental", "r2", "2024-01-02T00:00:00")
    return lake


@query(f"SELECT 'r1' AS run_id, 'full' AS mode, 'success' AS status, count(*) AS rows_ingested, count(*) FILTER ({MALFORMED}) AS rows_rejected FROM raw_products UNION ALL SELECT 'r2', 'incremental', 'success', count(*), count(*) FILTER ({MALFORMED}) FROM first_products WHERE last_modified_t % 40 = 0", "raw_products")
def m1_m4_k15_runs(spark, d):
    return _lake(spark, d)["runs"].read().select("run_id", "mode", "status", "rows_ingested", "rows_rejected")


@query("SELECT 'openfoodfacts|' || taxonomy_key AS wm_key, max(last_modified_t + CASE WHEN last_modified_t % 40 = 0 THEN 1000000000 ELSE 0 END) AS watermark_ts FROM raw_products GROUP BY taxonomy_key", "raw_products")
def m2_watermarks_after_runs(spark, d):
    return _lake(spark, d)["watermarks"].read().select("wm_key", "watermark_ts")


# Three runs of changes after a full one: products renamed, and others in French, which goes; stores that move, and others without a place; prices by line of the order, so
# that many arrive late. The SQL takes everything at once.

NEXT, FRENCH = 1_000_000_000, 2_000_000_000


def _changed(body: str) -> str:
    text = sql(body, "offers")
    columns = "brands, categories_tags, quantity"
    text = text.replace("raw_products AS (SELECT * FROM first_products UNION ALL", f"""raw_products AS (SELECT * FROM first_products
  UNION ALL SELECT barcode, product_name || ' next', {columns}, lang, last_modified_t + {NEXT}, taxonomy_key, ingested_at FROM first_products WHERE last_modified_t % 40 = 0
  UNION ALL SELECT barcode, product_name, {columns}, 'fr', last_modified_t + {FRENCH}, taxonomy_key, ingested_at FROM first_products WHERE last_modified_t % 70 = 0
  UNION ALL""")
    return text.replace("raw_stores AS (", "old_stores AS (").replace("stores AS (SELECT store_id, trim(name)", """raw_stores AS (SELECT store_id, name || CASE WHEN store_id::BIGINT % 10 = 3 THEN 'moved' ELSE '' END AS name, chain,
  CASE WHEN store_id::BIGINT % 9 <> 0 THEN lat END AS lat, lon FROM old_stores),
stores AS (SELECT store_id, trim(name)""")


def after_changes(spark: SparkSession, d: str) -> pipeline.Lake:
    lake = pipeline.Lake(spark, t.scratch(spark, "changes"))
    raw, stores, prices = t.raw_products(spark, d).drop("ingested_at"), t.raw_stores(spark, d), t.price_events(spark, d)
    once = raw.where("last_modified_t % 10 = 0")
    later = lambda rows, by: rows.withColumn("last_modified_t", F.col("last_modified_t") + by)
    line, key = F.substring("event_id", -4, 4).cast("int"), F.col("store_id").cast("long")
    moved = stores.where((key % 10 == 3) | (key % 9 == 0)).withColumns({"name": F.when(key % 10 == 3, F.concat("name", F.lit("moved"))).otherwise(F.col("name")), "lat": F.when(key % 9 != 0, F.col("lat")), "ingested_at": F.lit("2024-02-01T00:00:00")})
    none = raw.limit(0)
    steps = [
        ("full", raw, stores, prices.where(line <= 2)),
        ("incremental", later(once.where("last_modified_t % 40 = 0").withColumn("product_name", F.concat("product_name", F.lit(" next"))), NEXT), stores, prices.where((line == 3) | (line == 4))),
        ("incremental", none, moved, prices.where(line == 5)),
        ("incremental", later(once.where("last_modified_t % 70 = 0").withColumn("lang", F.lit("fr")), FRENCH), stores, prices.where(line >= 5)),
    ]
    for k, (mode, *of) in enumerate(steps):
        pipeline.run(lake, pipeline.Sources(*of), mode, f"r{k}", f"2024-01-0{k + 1}T00:00:00")
    return lake


@query()
def m4_a1_a2_w4_gold_after_changes(spark, d):
    """The products' rows, and beside each its category's."""
    lake = after_changes(spark, d)
    index = lake["product_search_index"].read().select("product_id", "category", "product_name", "search_terms", "num_stores_in_stock", F.col("min_price").alias("min_offer"))
    cheapest = lake["cheapest_products"].read().select("product_id", "cheapest_price", F.col("cheapest_store").alias("store"))
    return index.join(cheapest, "product_id", "left").join(lake["category_price_stats"].read(), "category", "full")


ORACLES["m4_a1_a2_w4_gold_after_changes"] = _changed(f"""SELECT * FROM (SELECT product_id, min(category) AS category, min(product_name) AS product_name, min(search_terms) AS search_terms, count(*) FILTER (in_stock) AS num_stores_in_stock, {ROUND('min(price)')} AS min_offer,
  {ROUND('min(price) FILTER (in_stock)')} AS cheapest_price, arg_min(store_name, {{'p': price, 's': store_id}}) FILTER (in_stock) AS store FROM offers GROUP BY product_id) FULL JOIN ({STATS}) USING (category)""")


@query("SELECT barcode AS product_id, category, base_price FROM products", "products")
def k5_k14_k16_exported_mart(spark, d):
    """The catalog after maintenance, as exported; newer records differ in their time alone."""
    lake = _lake(spark, d)
    pipeline.maintain_lake(lake, {"dim_product": ["base_price"]})
    path = pipeline.export_marts(lake, t.scratch(spark, "marts"), ("product_catalog",))["product_catalog"]
    return spark.read.parquet(path).select("product_id", "category", "base_price")


@query()
def s14_x12_modelled_prices(spark, d):
    return generators.modelled_prices(t.products(spark, d), generators.modelled_stores(spark))


# Streaming

PRICE = "CASE WHEN event_id % 16 = 3 THEN -value ELSE value + 1 END"
OK = f"event_id % 50 NOT IN (7, 8, 9) AND {PRICE} > 0"
ACCEPTED = f"""SELECT 2 AS schema_version, event_id, (user_id % 50)::INT AS store_id, (event_id % 97)::INT AS product_id, {PRICE} AS price, strftime(ts, '%Y-%m-%dT%H:%M:%S') AS observed_at,
  CASE WHEN event_id % 10 = 0 THEN true ELSE event_id % 9 <> 0 END AS in_stock, CASE WHEN event_id % 10 = 0 THEN 'USD' ELSE 'EUR' END AS currency FROM events WHERE {OK}"""


@query(ACCEPTED)
def t1_t2_t3_accepted(spark, d):
    return routing.accepted(routing.route(t.messages(spark, d)))


@query(f"SELECT CASE WHEN event_id % 50 = 7 THEN 'deserialize' WHEN event_id % 50 = 8 THEN 'missing fields: observed_at, price, product_id, store_id' WHEN event_id % 50 = 9 THEN 'unknown schema_version' ELSE 'invalid price' END AS error, count(*) AS n FROM events WHERE NOT ({OK}) GROUP BY 1")
def t9_k8_dead_letters(spark, d):
    return routing.dead_letters(routing.route(t.messages(spark, d)), F.lit(0)).groupBy("error").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, store_id, price FROM ({ACCEPTED})")
def t6_t8_stream_bronze(spark, d):
    """Messages written as files, streamed into a bronze table twice: the second delivery changes nothing."""
    source, state = t.scratch(spark, "messages"), t.scratch(spark, "checkpoint")
    t.messages(spark, d).select("value").write.text(source)
    bronze, dead = LakeTable(spark, t.scratch(spark, "bronze")), LakeTable(spark, t.scratch(spark, "dead"))
    for k in range(2):
        jobs.start_bronze(jobs.file_messages(spark, source), bronze, dead, f"{state}/{k}", once=True).awaitTermination()
    return bronze.read().select("event_id", "store_id", "price")


BAD = f"SELECT CASE WHEN event_id % 50 = 7 THEN 'deserialize' WHEN event_id % 50 = 8 THEN 'missing fields: observed_at, price, product_id, store_id' WHEN event_id % 50 = 9 THEN 'unknown schema_version' ELSE 'invalid price' END AS error FROM events WHERE NOT ({OK})"


def _streamed(spark, d, update: bool) -> tuple[LakeTable, LakeTable]:
    """Messages of even and of odd offsets, each from a stream with a checkpoint of its own, and the first of them delivered again."""
    bronze, dead, state = LakeTable(spark, t.scratch(spark, "bronze")), LakeTable(spark, t.scratch(spark, "dead")), t.scratch(spark, "checkpoint")
    sources = [t.scratch(spark, f"messages{k}") for k in range(2)]
    for k, path in enumerate(sources):
        t.messages(spark, d).where(F.col("offset") % 2 == k).select("value").write.text(path)
    for k, (path, name) in enumerate(((sources[0], "even"), (sources[1], "odd"), (sources[0], "even"))):
        jobs.start_bronze(jobs.file_messages(spark, path), bronze, dead, f"{state}/{k}", update=update, once=True, source=name).awaitTermination()
    return bronze, dead


@query(f"SELECT error, count(*) AS n FROM ({BAD}) GROUP BY error")
def k8_dead_letters_after_restarts(spark, d):
    return _streamed(spark, d, False)[1].read().groupBy("error").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, store_id, price FROM ({ACCEPTED})")
def k9_t8_upserting_stream(spark, d):
    return _streamed(spark, d, True)[0].read().select("event_id", "store_id", "price")


@query(f"SELECT 'dlq' AS route, error, count(*) AS n FROM ({BAD}) GROUP BY error")
def s8_replayed_dead_letters(spark, d):
    """Dead letters routed anew fail as before."""
    dead = routing.dead_letters(routing.route(t.messages(spark, d)), F.lit(0))
    return routing.route(files.replay_dead_letters(dead)).groupBy("route", "error").agg(F.count("*").alias("n"))


@query(f"SELECT event_id, observed_at::TIMESTAMP AS event_ts, left(observed_at, 10) AS event_date FROM ({ACCEPTED})")
def t5_parsed_times(spark, d):
    return jobs.parsed(t.messages(spark, d)).select("event_id", F.col("event_ts").cast("timestamp_ntz").alias("event_ts"), F.col("event_date").cast("string").alias("event_date"))


@query(f"SELECT store_id::VARCHAR AS key, event_id, price FROM ({ACCEPTED})")
def t10_k7_published(spark, d):
    """Accepted events as messages, checked before they are sent, and read back."""
    sent = routing.to_message(routing.accepted(routing.route(t.messages(spark, d))))
    return sent.select("key", F.from_json("value", "event_id bigint, price double").alias("v")).select("key", "v.event_id", "v.price")


def _thirds(events: DataFrame, n: int) -> DataFrame:
    """batch: the third, as ntile(3) by event_id. Rows are counted by ranges of ids, and numbered within these, so that no task holds the whole order; the window over all has a row a range."""
    ranged = events.withColumn("_range", F.floor(F.col("event_id") / 65_536))
    before = F.coalesce(F.sum("count").over(Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    ranges = ranged.groupBy("_range").count().select("_range", before.alias("_before"))
    rank = F.col("_before") + F.row_number().over(Window.partitionBy("_range").orderBy("event_id")) - 1
    size, more = max(n // 3, 1), n % 3
    edge = more * (size + 1) if n >= 3 else n
    rows = ranged.join(ranges, "_range").withColumn("_rank", rank)
    batch = F.when(F.col("_rank") < edge, F.floor(F.col("_rank") / (size + 1 if n >= 3 else 1))).otherwise(more + F.floor((F.col("_rank") - edge) / size)) + 1
    return rows.withColumn("batch", batch.cast("int")).drop("_range", "_before", "_rank")


FILE_ROWS = 500_000


@query(f"""WITH b AS (SELECT event_id, ts, ntile(3) OVER (ORDER BY event_id) AS batch FROM events WHERE {OK}),
w AS (SELECT *, (SELECT date_trunc('second', max(o.ts)) - INTERVAL 1 HOUR FROM b o WHERE o.batch < b.batch - 1) AS mark FROM b)
SELECT event_id FROM w WHERE mark IS NULL OR date_trunc('second', ts) > mark""")
def t4_t5_watermarked_stream(spark, d):
    """Messages in three batches, the first of them delivered again at the end: each event once, and none that is later than the watermark of the batch before."""
    source, state = t.scratch(spark, "messages"), t.scratch(spark, "checkpoint")
    accepted = routing.accepted(routing.route(t.messages(spark, d))).persist()
    n = accepted.count()
    events, of_batch = _thirds(accepted, n), max(1, -(-n // (3 * FILE_ROWS)))
    for k in (1, 2, 3, 1):
        routing.to_message(events.where(F.col("batch") == k).drop("batch")).select("value").repartition(of_batch).write.mode("append").text(source)
    on_time, late = LakeTable(spark, t.scratch(spark, "on-time")), LakeTable(spark, t.scratch(spark, "late"))
    jobs.start_flagged(jobs.file_messages(spark, source, of_batch), on_time, late, state, once=True).awaitTermination()
    return on_time.read().select("event_id").unionByName(late.read().select("event_id"))


# Matching and planning

CART = ["milk", "rice", "chicken breast", "spinach", "oat drink"]


def _cart(spark):
    return spark.createDataFrame([(q,) for q in CART], "query string")


MATCH = f"""stocked AS (SELECT * FROM offers WHERE in_stock), q(query) AS (VALUES {", ".join(f"('{c}')" for c in CART)}),
texts AS (SELECT product_id, unnest(list_append(list_filter(string_split(coalesce(search_terms, ''), '|'), lambda x: x <> ''), coalesce(product_name, ''))) AS candidate
  FROM (SELECT DISTINCT product_id, product_name, search_terms FROM stocked)),
pairs AS (SELECT query, candidate, {SORTED.format('query')} AS a, {SORTED.format('candidate')} AS b FROM q, (SELECT DISTINCT candidate FROM texts)),
scored AS (SELECT query, candidate, CASE WHEN lower(trim(query)) = lower(trim(candidate)) THEN 1.0::DOUBLE WHEN length(a) + length(b) = 0 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * {LCS} / (length(a) + length(b)) END AS score FROM pairs),
best AS (SELECT query, product_id, max(score) AS score FROM texts JOIN scored USING (candidate) GROUP BY query, product_id),
matches AS (SELECT query, store_id, CASE WHEN score >= 0.72 THEN product_id END AS product_id, CASE WHEN score >= 0.72 THEN product_name END AS product_name, CASE WHEN score >= 0.72 THEN price END AS price,
  CASE WHEN score >= 0.72 THEN {ROUND('score', 3)} END AS score, CASE WHEN score >= 0.72 THEN 'fuzzy' ELSE 'none' END AS method, score >= 0.72 AS available
  FROM stocked JOIN best USING (product_id) QUALIFY row_number() OVER (PARTITION BY query, store_id ORDER BY score DESC, price, product_id) = 1)"""


# Answers give the score of what isn't accepted, too.
ANSWERS = MATCH.replace(f"CASE WHEN score >= 0.72 THEN {ROUND('score', 3)} END AS score", f"{ROUND('score', 3)} AS score")


def matched(body: str, match: str = MATCH):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql("", "offers").rstrip() + ", " + match + "\n" + body
        return f

    return register


def _written_offers(spark: SparkSession, d: str) -> DataFrame:
    """The offers as a table, with the columns that carts ask for: they are read for products, stores and prices, and each time would be taken from the latest prices and joined anew."""
    path = t.scratch(spark, "offers")
    rows = t.offers(spark, d).select("store_id", "lat", "lon", "product_id", "product_name", "search_terms", "price", "in_stock")
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


@matched("SELECT * FROM matches", ANSWERS)
def b2_x9_match(spark, d):
    offers = _written_offers(spark, d)
    return matching.answers(matching.match_at_stores(_cart(spark), offers), _cart(spark), offers.where("in_stock"))


@matched(f"SELECT query, arg_min(product_name, k) AS product_name, arg_min(store_id, k) AS store_id, max(score) AS score, count(*) AS num_stores, {ROUND('min(price)')} AS min_price, {ROUND('max(price)')} AS max_price FROM (SELECT *, {{'s': -score, 'p': price, 't': store_id, 'i': product_id}} AS k FROM matches WHERE available) GROUP BY query")
def b3_a12_match_items(spark, d):
    return matching.match_items(matching.match_at_stores(_cart(spark), _written_offers(spark, d)))


OPTIONS = f"""cart(item, qty) AS (VALUES ('milk', 2), ('rice', 1), ('eggs', 1), ('bread', 3), ('caviar', 1)),
near AS (SELECT store_id, {KM} AS km FROM stores ORDER BY 2, 1 LIMIT 50),
opts AS (SELECT category AS item, store_id, price, 0.9::DOUBLE AS score FROM offers WHERE in_stock AND store_id IN (SELECT store_id FROM near) QUALIFY row_number() OVER (PARTITION BY category, store_id ORDER BY price, product_id) = 1),
sets AS (SELECT [] ::VARCHAR[] AS s, 0.0::DOUBLE AS km UNION ALL SELECT [store_id], 2 * km FROM near
  UNION ALL SELECT [a.store_id, b.store_id], 2 * a.km + 2 * b.km FROM near a JOIN near b ON a.store_id < b.store_id
  UNION ALL SELECT [a.store_id, b.store_id, c.store_id], 2 * a.km + 2 * b.km + 2 * c.km FROM near a JOIN near b ON a.store_id < b.store_id JOIN near c ON b.store_id < c.store_id),
costs AS (SELECT s, item, min(1.0::DOUBLE * qty * price + 6.0::DOUBLE * (1.0::DOUBLE - score)) AS cost FROM sets JOIN opts ON list_contains(s, store_id) JOIN cart USING (item) GROUP BY s, item),
plans AS (SELECT array_to_string(sets.s, '|') AS set_id, len(sets.s)::INT AS size, coalesce(sum(cost) FILTER (cost < 25), 0.0::DOUBLE) AS items_cost, 5 - count(cost) FILTER (cost < 25) AS missing, any_value(km) AS km
  FROM sets LEFT JOIN costs ON sets.s = costs.s GROUP BY sets.s),
priced AS (SELECT set_id, size, items_cost, missing, {ROUND('(5 - missing) / 5.0::DOUBLE', 4)} AS coverage, {ROUND('items_cost + 25.0::DOUBLE * missing + 2.5::DOUBLE * size + 0.4::DOUBLE * km', 3)} AS objective FROM plans)"""


def _plans(spark, d):
    cart = spark.createDataFrame([("milk", 2), ("rice", 1), ("eggs", 1), ("bread", 3), ("caviar", 1)], "item string, qty int")
    near = planner.nearest(_near(spark, d), 50)
    stocked = t.offers(spark, d).where("in_stock").join(F.broadcast(near.select("store_id")), "store_id")
    cheapest = stocked.groupBy(F.col("category").alias("item"), "store_id").agg(F.min("price").alias("price")).withColumn("score", F.lit(0.9))
    return cart, cheapest, near


def _planned(body: str) -> str:
    return sql("", "offers").rstrip() + ", " + OPTIONS + "\n" + body


def planned(body: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, _planned(body)
        return f

    return register


@planned(f"SELECT set_id, size, {ROUND('items_cost', 4)} AS items_cost, missing, coverage, objective FROM priced")
def a13_x20_plan_costs(spark, d):
    cart, options, near = _plans(spark, d)
    return planner.plan_costs(cart, options, planner.store_sets(near, 3)).withColumn("items_cost", text.half_up(F.col("items_cost"), 4))


def _searched(spark, d) -> DataFrame:
    return planner.search(*_plans(spark, d), 3).plans


@planned(f"SELECT set_id, size, {ROUND('items_cost', 4)} AS items_cost, missing, coverage, objective FROM priced ORDER BY objective, size, set_id LIMIT 1")
def a15_b5_b6_best_plan(spark, d):
    return planner.best_plan(_searched(spark, d)).withColumn("items_cost", text.half_up(F.col("items_cost"), 4))


@planned("SELECT set_id, objective FROM priced WHERE size = 1 ORDER BY objective, size, set_id LIMIT 1")
def b4_single_store(spark, d):
    return planner.single_store_plan(_searched(spark, d)).select("set_id", "objective")


RECOMMENDED = f"SELECT s.objective AS single_objective, s.set_id AS single_set, m.objective AS multi_objective, m.set_id AS multi_set, {ROUND('s.objective - m.objective', 3)} AS savings, CASE WHEN m.objective < s.objective THEN 'multi_store' ELSE 'single_store' END AS recommended FROM (SELECT * FROM priced WHERE size = 1 ORDER BY objective, size, set_id LIMIT 1) s, (SELECT * FROM priced WHERE size >= 1 ORDER BY objective, size, set_id LIMIT 1) m"


@planned(RECOMMENDED)
def b7_b8_recommended(spark, d):
    return planner.recommended(_searched(spark, d))


@planned(f"SELECT recommended, CASE WHEN recommended = 'multi_store' THEN printf('shop at %s and save %.2f over one store', multi_set, savings) ELSE 'shop at ' || single_set END AS explanation FROM ({RECOMMENDED})")
def x21_b8_explained(spark, d):
    return planner.summary(planner.recommended(_searched(spark, d))).select("recommended", "explanation")


@planned("""SELECT item, qty, l.store_id, l.price, l.score, l.cost, a.store_id AS alternative_store, a.price AS alternative_price, coalesce(printf('%s at %.2f', l.store_id, l.price), 'not carried at an acceptable cost') AS explanation
FROM cart LEFT JOIN (SELECT item, arg_min(o, k) AS l FROM (SELECT item, {'store_id': store_id, 'price': price, 'score': score, 'cost': cost} AS o, {'c': cost, 's': store_id} AS k
    FROM (SELECT item, store_id, price, score, 1.0::DOUBLE * qty * price + 6.0::DOUBLE * (1.0::DOUBLE - score) AS cost FROM opts JOIN cart USING (item)
          WHERE store_id IN (SELECT unnest(string_split(set_id, '|')) FROM (SELECT set_id FROM priced ORDER BY objective, size, set_id LIMIT 1))) WHERE cost < 25) GROUP BY item) b USING (item)
LEFT JOIN LATERAL (SELECT arg_min({'store_id': opts.store_id, 'price': opts.price}, {'p': opts.price, 's': opts.store_id}) AS a FROM opts WHERE opts.item = cart.item AND opts.store_id <> l.store_id) x ON true""")
def o6_b7_assignments(spark, d):
    cart, options, near = _plans(spark, d)
    return planner.assignments(planner.best_plan(planner.search(cart, options, near, 3).plans), cart, options)


NEAR = f"near AS (SELECT store_id, {KM} AS km FROM (SELECT DISTINCT store_id, lat, lon FROM offers) ORDER BY 2, 1 LIMIT 50)"
CART_OPTIONS = OPTIONS[OPTIONS.index("sets AS ("):]


def carted(body: str):
    def register(f):
        rows = ", ".join(f"('{c}', {k % 3 + 1})" for k, c in enumerate(CART))
        match = MATCH.replace("FROM offers WHERE in_stock", "FROM offers WHERE in_stock AND store_id IN (SELECT store_id FROM near)")
        opts = "opts AS (SELECT query AS item, store_id, price, score FROM matches WHERE available)"
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql("", "offers").rstrip() + f", cart(item, qty) AS (VALUES {rows}), {NEAR}, {match}, {opts}, {CART_OPTIONS}\n{body}"
        return f

    return register


def _answer(spark, d) -> planner.CartPlan:
    cart = spark.createDataFrame([(c, k % 3 + 1) for k, c in enumerate(CART)], "item string, qty int")
    return planner.optimize_cart(cart, _written_offers(spark, d), *CENTRE)


@carted(f"SELECT s.objective AS single_objective, s.set_id AS single_set, m.objective AS multi_objective, m.set_id AS multi_set, {ROUND('s.objective - m.objective', 3)} AS savings, CASE WHEN m.objective < s.objective THEN 'multi_store' ELSE 'single_store' END AS recommended FROM (SELECT * FROM priced WHERE size = 1 ORDER BY objective, size, set_id LIMIT 1) s, (SELECT * FROM priced WHERE size >= 1 ORDER BY objective, size, set_id LIMIT 1) m")
def b1_b7_optimize_cart(spark, d):
    return _answer(spark, d).recommendation.drop("explanation")


@carted("SELECT set_id, size, missing, coverage, objective FROM priced")
def a14_cart_coverage(spark, d):
    return _answer(spark, d).costs.select("set_id", "size", "missing", "coverage", "objective")


@query("SELECT store_id, product_id, price FROM offers WHERE product_id IN (SELECT product_id FROM offers WHERE store_id = '7')", "offers")
def j8_lookup(spark, d):
    offers = t.offers(spark, d)
    return planner.lookup(offers, offers.where("store_id = '7'"), "product_id").select("store_id", "product_id", "price")


@query(f"""SELECT c.*, s.num_products, s.avg_price FROM (SELECT product_id, product_name, category, {ROUND('price')} AS cheapest_price, store_name AS cheapest_store FROM offers WHERE in_stock
  QUALIFY row_number() OVER (PARTITION BY product_id ORDER BY price, store_id) = 1) c JOIN ({STATS}) s USING (category)""", "offers")
def flagship_cheapest_with_stats(spark: SparkSession, d: str) -> DataFrame:
    """The cheapest current offer of each product, with its category's statistics."""
    rows = t.offers(spark, d)
    return medallion.cheapest_products(rows).join(medallion.category_price_stats(rows).select("category", "num_products", "avg_price"), "category")
