"""Run metadata: runs, watermarks, metrics, freshness. Clocks and ids are injected, so results repeat."""

from __future__ import annotations

import uuid
from datetime import datetime, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.text import half_up
from millrace.operators.medallion import filled

FRESH_HOURS = 48.0


def new_run_id() -> str:
    return uuid.uuid4().hex[:12]


def utc_now() -> str:
    return datetime.now(timezone.utc).isoformat()


def run_row(spark: SparkSession, run_id: str, source: str, mode: str, started_at: str, finished_at: str, status: str, rows_ingested: int, rows_rejected: int, duration_s: float) -> DataFrame:
    """One row of the run log; failures are recorded like successes."""
    schema = "run_id string, source string, mode string, started_at string, finished_at string, status string, rows_ingested long, rows_rejected long, duration_s double"
    return spark.createDataFrame([(run_id, source, mode, started_at, finished_at, status, rows_ingested, rows_rejected, duration_s)], schema)


def rejected(raw: DataFrame) -> DataFrame:
    """n: rows without bar code or name."""
    return raw.agg(F.count_if(~filled("barcode", "product_name")).alias("n"))


def watermarks(raw: DataFrame, source: str, now: str) -> DataFrame:
    """The greatest change time of each category; null counts as 0."""
    top = raw.groupBy(F.col("taxonomy_key").alias("category")).agg(F.max(F.coalesce("last_modified_t", F.lit(0))).cast("long").alias("watermark_ts"))
    return top.select(F.concat_ws("|", F.lit(source), "category").alias("wm_key"), F.lit(source).alias("source"), "category", "watermark_ts", F.lit(now).alias("updated_at"))


def since(raw: DataFrame, marks: DataFrame) -> DataFrame:
    """Rows changed strictly after their category's watermark; no watermark counts as 0."""
    held = marks.select(F.col("category").alias("_category"), F.col("watermark_ts").alias("_mark"))
    joined = raw.join(held, F.col("taxonomy_key") == F.col("_category"), "left")
    return joined.where(F.coalesce("last_modified_t", F.lit(0)) > F.coalesce("_mark", F.lit(0))).drop("_category", "_mark")


def row_counts(tables: dict[str, DataFrame], run_id: str, now: str) -> DataFrame:
    one = lambda name, df: df.agg(F.count("*").cast("double").alias("value")).select(F.lit(run_id).alias("run_id"), F.lit("row_count").alias("metric"), F.lit(name).alias("target"), "value", F.lit(now).alias("captured_at"))
    return reduce(DataFrame.unionByName, [one(n, d) for n, d in sorted(tables.items())])


def metric_rows(spark: SparkSession, counts: dict[str, int], run_id: str, now: str, metric: str = "row_count") -> DataFrame:
    """The rows of ``row_counts`` from counts that are known already."""
    rows = [(run_id, metric, name, float(n), now) for name, n in sorted(counts.items())]
    return spark.createDataFrame(rows, "run_id string, metric string, target string, value double, captured_at string")


def freshness_hours(newest: Column, now_seconds: Column | int) -> Column:
    seconds = F.lit(now_seconds) if isinstance(now_seconds, int) else now_seconds
    return half_up((seconds - newest) / F.lit(3600.0), 1)


def is_fresh(metrics: DataFrame, limit: float = FRESH_HOURS) -> DataFrame:
    """fresh: whether the latest run's freshness is below the limit."""
    rows = metrics.where("metric = 'freshness_hours'")
    last = rows.agg(F.max_by("run_id", "captured_at").alias("run_id"))
    return rows.join(F.broadcast(last), "run_id").agg((F.max("value") < limit).alias("fresh"))
