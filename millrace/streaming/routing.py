"""Price-event messages: versioned validation, upgrade, routing, late flags. The same on batches and streams.

Nulls, NaN and infinite prices, messages that aren't JSON objects and events without a usable event_id
are dead letters too, though a check for presence alone would let them pass.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.functions.events import event_seconds

# Required fields of each schema version, the latest version and the allowed lateness.
REQUIRED = {1: ("event_id", "store_id", "product_id", "price", "observed_at"), 2: ("event_id", "store_id", "product_id", "price", "observed_at", "in_stock", "currency")}
LATEST_VERSION = 2
ALLOWED_LATENESS = 3600.0


def route(messages: DataFrame, value: str = "value") -> DataFrame:
    """route (ok or dlq), error, raw, and the event upgraded to the latest version, beside the input's columns.

    A message is parsed once into its fields, and once more to reject what isn't JSON as a whole; a one-element generator
    holds the parsed row, for filters on what is derived would be pushed below a projection and parse again at each use.
    """
    names = sorted({n for needed in REQUIRED.values() for n in needed})
    # Text of any JSON value, and null where there is none; the price's own type matters.
    schema = ", ".join(f"{n} {'variant' if n == 'price' else 'string'}" for n in ("schema_version", *names))
    rows = messages.withColumn("raw", F.col(value).cast("string"))
    whole = F.try_parse_json("raw").isNotNull() & F.ltrim(F.translate("raw", "\t\r\n", "   ")).startswith("{")
    rows = rows.select("*", F.explode(F.array(F.when(whole, F.from_json("raw", schema)))).alias("_fields"))
    field = lambda n: F.col(f"_fields.{n}")
    version, first = field("schema_version").try_cast("int"), field("schema_version").try_cast("int") == 1
    numeric = F.schema_of_variant(field("price")).rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*|INT|SMALLINT|TINYINT)$")
    absent = [F.when(field(n).isNull() | F.coalesce(F.is_variant_null(field(n)), F.lit(True)) if n == "price" else field(n).isNull(), F.lit(n)) for n in names]
    needed = F.array().cast("array<string>")
    for number, of in REQUIRED.items():
        needed = F.when(version == number, F.array(*[F.lit(n) for n in of])).otherwise(needed)
    missing = F.array_join(F.array_intersect(F.array_compact(F.array(*absent)), needed), ", ")
    rows = rows.withColumn("_version", version).withColumn("_missing", missing).withColumn("_price", F.when(numeric, F.try_variant_get(field("price"), "$", "double"))).withColumn("_id", field("event_id").try_cast("bigint"))
    price = F.col("_price")
    error = (
        F.when(F.col("_fields").isNull(), F.lit("deserialize"))
        .when(F.col("_version").isNull() | ~F.col("_version").isin(*REQUIRED), F.lit("unknown schema_version"))
        .when(F.col("_missing") != "", F.concat(F.lit("missing fields: "), F.col("_missing")))
        .when(price.isNull() | F.isnan(price) | (price <= 0) | (price == float("inf")), F.lit("invalid price"))
        .when(F.col("_id").isNull(), F.lit("invalid event_id"))
    )
    event = F.struct(
        F.lit(LATEST_VERSION).alias("schema_version"), F.col("_id").alias("event_id"), field("store_id").try_cast("int").alias("store_id"), field("product_id").try_cast("int").alias("product_id"), price.alias("price"),
        field("observed_at").alias("observed_at"), F.coalesce(field("in_stock").try_cast("boolean"), F.when(first, F.lit(True))).alias("in_stock"), F.coalesce(field("currency"), F.when(first, F.lit("USD"))).alias("currency"),
    )
    rows = rows.withColumn("error", error).withColumn("event", F.when(F.col("error").isNull(), event))
    way = F.when(F.col("error").isNull(), "ok").otherwise("dlq").alias("route")
    return rows.select(*messages.columns, *[c for c in ("raw", "error") if c not in messages.columns], way, "event")


def accepted(routed: DataFrame) -> DataFrame:
    return routed.where("route = 'ok'").select("event.*")


def dead_letters(routed: DataFrame, dlq_at: Column | None = None) -> DataFrame:
    return routed.where("route = 'dlq'").select("error", "raw", (F.unix_timestamp() if dlq_at is None else dlq_at).alias("dlq_at"))


def counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("route").agg(F.count("*").alias("n"))


def to_message(event: DataFrame) -> DataFrame:
    """key (store_id) and value (JSON) of events to publish; an invalid event raises before anything is sent."""
    json = F.to_json(F.struct(*event.columns))
    checked = route(event.select(F.col("store_id").cast("string").alias("key"), json.alias("value")))
    value = F.when(F.col("route") == "ok", F.col("value")).otherwise(F.raise_error(F.concat(F.lit("invalid event: "), F.col("error"))).cast("string"))
    return checked.select("key", value.alias("value"))


def late_in_order(events: DataFrame, order: str, lateness: float = ALLOWED_LATENESS, seconds: Column | None = None, groups: list[str] | None = None, ties: list[str] | None = None) -> DataFrame:
    """Adds _late: event time more than ``lateness`` before the greatest seen earlier in ``order``.

    One order over all events can't be dealt out, unless blocks of it are summed up first: the greatest
    time of each block of the order goes to all later blocks, and rows are compared within their block.
    With ``groups``, each group has its own order. Rows of equal ``order`` go by the columns of ``ties``.
    """
    t = event_seconds(F.col("observed_at")) if seconds is None else seconds
    rows, whole = events.withColumn("_t", t), [order, *(ties or [])]
    if groups:
        before = F.max("_t").over(Window.partitionBy(*groups).orderBy(*whole).rowsBetween(Window.unboundedPreceding, -1))
        return rows.withColumn("_late", F.coalesce((before > 0) & (F.col("_t") < before - lateness), F.lit(False))).drop("_t")
    size = 100_000
    rows = rows.withColumn("_block", F.floor(F.col(order) / size))
    tops = rows.groupBy("_block").agg(F.max("_t").alias("_top"))
    # One row for each block of the order: a window over these is small.
    tops = tops.select("_block", F.max("_top").over(Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)).alias("_carried"))
    within = F.max("_t").over(Window.partitionBy("_block").orderBy(*whole).rowsBetween(Window.unboundedPreceding, -1))
    rows = rows.withColumn("_within", within).join(tops, "_block")
    before = F.greatest("_within", "_carried")
    return rows.withColumn("_late", F.coalesce((before > 0) & (F.col("_t") < before - lateness), F.lit(False))).drop("_t", "_block", "_within", "_carried")
