"""File sources: JSON fixtures, CSV seeds, tables as views, replays."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.sources.api import SCHEMA


def read_products_json(spark: SparkSession, path: str) -> DataFrame:
    """A JSON array of raw product records, with the fixed schema, so nothing is inferred."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path)


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.option("header", True).schema("taxonomy_key string, product_group string, term string, base_price double").csv(path)


def query(spark: SparkSession, sql: str, **tables: DataFrame) -> DataFrame:
    """SQL over DataFrames by name; the names aren't registered in the session."""
    return spark.sql(sql, **tables) if tables else spark.sql(sql)


def replay_from(log: DataFrame, from_ms: int, limit: int | None = None) -> DataFrame:
    """Messages of a log (ts_ms, key, value) from a time on, in order."""
    rows = log.where(F.col("ts_ms") >= from_ms).orderBy("ts_ms", "key", "value")
    return rows if limit is None else rows.limit(limit)


def replay_dead_letters(dead: DataFrame, limit: int | None = None) -> DataFrame:
    """The original messages of dead letters, for routing them anew."""
    rows = dead.select(F.col("raw").alias("value"))
    return rows if limit is None else rows.limit(limit)
