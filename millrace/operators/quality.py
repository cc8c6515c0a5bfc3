"""Checks, expectations and quarantine. Checks of a table are aggregates of one pass over it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from millrace.functions.events import positive
from millrace.functions.gtin import has_gtin_length, valid_gtin
from millrace.operators.medallion import filled

MAX_PRICE = 1000


def bad_price(price: Column) -> Column:
    return price.isNull() | (price <= 0) | (price > MAX_PRICE)


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """failed_count, total_count: rows beyond the first of each key; nulls are one key. Counted by groups, so nothing is gathered."""
    return df.groupBy(key).count().agg((F.coalesce(F.sum("count"), F.lit(0)) - F.count("*")).alias("failed_count"), F.coalesce(F.sum("count"), F.lit(0)).alias("total_count"))


# Name, layer, table, severity and detail of the standard checks.
CHECKS = (
    ("malformed_records", "bronze", "raw_products", "warn", "empty barcode or product_name"),
    ("duplicate_products", "silver", "dim_product", "error", "barcode must be unique"),
    ("missing_categories", "silver", "dim_product", "error", "category must be set"),
    ("invalid_upcs", "silver", "dim_product", "warn", "GTIN check digit failed"),
    ("invalid_prices", "gold", "store_product_offers", "error", "price must be in (0, 1000]"),
)


def run_checks(bronze: DataFrame, products: DataFrame, offers: DataFrame, run_id: str, now: str) -> DataFrame:
    """One row for each of the five standard checks; each input is read once."""
    # By bar code first, so that nothing is gathered; nulls are one code.
    codes = products.groupBy("barcode").agg(F.count("*").alias("n"), F.count_if(~filled("category")).alias("missing"))
    counts = {
        "malformed_records": F.count_if(~filled("barcode", "product_name")), "invalid_prices": F.count_if(bad_price(F.col("price"))),
        "duplicate_products": F.sum("n") - F.count("*"), "missing_categories": F.sum("missing"), "invalid_upcs": F.sum(F.when(~valid_gtin(F.col("barcode")), F.col("n"))),
    }
    out = []
    for table, df, total in (("raw_products", bronze, F.count("*")), ("dim_product", codes, F.sum("n")), ("store_product_offers", offers, F.count("*"))):
        checks = [c for c in CHECKS if c[2] == table]
        one = df.agg(F.coalesce(total, F.lit(0)).cast("long").alias("total"), *[F.coalesce(counts[name], F.lit(0)).cast("long").alias(name) for name, *_ in checks])
        results = F.array(*[F.struct(*[F.lit(x).alias(n) for n, x in zip(("check_name", "layer", "table", "severity", "detail"), c)], F.col(c[0]).alias("failed_count")) for c in checks])
        out.append(one.select(F.explode(results).alias("c"), "total"))
    rows = reduce(DataFrame.unionByName, out)
    return rows.select(
        F.lit(run_id).alias("run_id"), "c.check_name", "c.layer", "c.table", "c.severity", "c.failed_count", F.col("total").alias("total_count"),
        (F.col("c.failed_count") == 0).alias("passed"), "c.detail", F.lit(now).alias("checked_at"),
    )


class Watch:
    """Counts of rows and of failing rows, taken by the job that writes them: write ``rows``, then read ``counts``."""

    def __init__(self, df: DataFrame, **failing: Column):
        self._seen = Observation()
        self.rows = df.observe(self._seen, F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in failing.items()])

    def counts(self) -> dict[str, int]:
        """Waits for the job; without one it would wait for ever."""
        return self._seen.get


#: The standard checks that a row fails on its own; duplicates take a shuffle.
ROW_CHECKS = {
    "raw_products": lambda: {"malformed_records": ~filled("barcode", "product_name")},
    "dim_product": lambda: {"missing_categories": ~filled("category"), "invalid_upcs": ~valid_gtin(F.col("barcode"))},
    "store_product_offers": lambda: {"invalid_prices": bad_price(F.col("price"))},
}


def watch(df: DataFrame, table: str) -> Watch:
    """The table's standard checks, for the job that writes it."""
    return Watch(df, **ROW_CHECKS[table]())


def tally(df: DataFrame, table: str) -> dict[str, int]:
    """The same counts of rows that are there already."""
    failing = ROW_CHECKS[table]() if table in ROW_CHECKS else {}
    return df.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(c).alias(name) for name, c in failing.items()]).first().asDict()


def checked(counts: dict[str, dict[str, int]], duplicate_products: int, spark: SparkSession, run_id: str, now: str) -> DataFrame:
    """The rows of ``run_checks`` from what the writing jobs counted."""
    failed = {name: n for table in counts.values() for name, n in table.items()} | {"duplicate_products": duplicate_products}
    rows = [(run_id, *c[:4], failed[c[0]], counts[c[2]]["total"], failed[c[0]] == 0, c[4], now) for c in CHECKS]
    return spark.createDataFrame(rows, "run_id string, check_name string, layer string, table string, severity string, failed_count long, total_count long, passed boolean, detail string, checked_at string")


class QualityGate(RuntimeError):
    """Checks of severity error failed."""


def gate(results: DataFrame) -> DataFrame:
    """The results again, or QualityGate with the names of the failed checks of severity error; there are as many rows as checks."""
    failed = sorted(r.check_name for r in results.where("severity = 'error' AND NOT passed").select("check_name").distinct().collect())
    if failed:
        raise QualityGate(", ".join(failed))
    return results


def hard_failures(results: DataFrame) -> DataFrame:
    """n: failed checks of severity error in the latest run."""
    last = results.agg(F.max_by("run_id", "checked_at").alias("run_id"))
    return results.join(F.broadcast(last), "run_id").agg(F.count_if((F.col("severity") == "error") & ~F.col("passed")).alias("n"))


def quarantine(bronze: DataFrame, run_id: str, now: str) -> DataFrame:
    """Rows without bar code or name, with the reason."""
    reason = F.when(~filled("barcode"), F.lit("missing_barcode")).otherwise(F.lit("missing_name"))
    rows = bronze.where(~filled("barcode", "product_name"))
    return rows.select(F.lit(run_id).alias("run_id"), "barcode", "product_name", "taxonomy_key", reason.alias("quarantine_reason"), F.lit(now).alias("quarantined_at"))


# Expectations: each gives the rows that fail.

def not_null(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNull())


def unique(df: DataFrame, column: str) -> DataFrame:
    return df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n_records")).where("n_records > 1")


def accepted_values(df: DataFrame, column: str, values: list) -> DataFrame:
    return df.where(F.col(column).isNotNull() & ~F.col(column).isin(*values))


def only_positive(df: DataFrame, column: str) -> DataFrame:
    return df.where(~positive(F.col(column)))


def gtin_shaped(df: DataFrame, column: str) -> DataFrame:
    return df.where(~has_gtin_length(F.col(column)))


def relationships(df: DataFrame, column: str, parent: DataFrame, parent_column: str) -> DataFrame:
    """Rows whose key has no parent; null keys pass."""
    keys = parent.select(F.col(parent_column).alias("_parent")).where(F.col("_parent").isNotNull()).distinct()
    return df.where(F.col(column).isNotNull()).join(keys, F.col(column) == F.col("_parent"), "left_anti")
