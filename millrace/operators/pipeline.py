"""End-to-end runs: land, silver, gold, checks, metrics and watermarks, with a log of every run."""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from millrace.operators import incremental, medallion, quality, runs, schema
from millrace.operators.tables import LakeTable, maintain
from millrace.sources.api import SCHEMA


@dataclass(frozen=True)
class Sources:
    """Raw inputs: products, stores and price events."""

    products: DataFrame
    stores: DataFrame
    events: DataFrame


class Lake:
    """The tables of the medallion below one folder."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def __getitem__(self, name: str) -> LakeTable:
        return LakeTable(self.spark, f"{self.root}/{name}")

    def log(self, name: str, rows: DataFrame) -> None:
        """Appends to a table of the log."""
        self[name].write(rows, "append")


def _ingest(lake: Lake, sources: Sources, mode: str, run_id: str, now: str, source: str, gated: bool) -> tuple[int, int]:
    spark, fresh = lake.spark, sources.products
    if mode == "incremental" and lake["watermarks"].exists():
        fresh = runs.since(fresh, lake["watermarks"].read().where(F.col("source") == source))
    lake.log("drift", schema.drift(spark, StructType.fromDDL(SCHEMA), fresh.schema).withColumn("run_id", F.lit(run_id)))
    landed = medallion.land(fresh, run_id, now, source)
    bronze = lake["bronze_products"]
    # Rows, failing rows and metrics are counted by the jobs that write the tables.
    seen = quality.watch(landed, "raw_products")
    bronze.write(seen.rows, "append" if mode == "incremental" else "overwrite")
    new = bronze.read().where(F.col("run_id") == run_id)
    lake.log("quarantine", quality.quarantine(new, run_id, now))
    counts = {"raw_products": seen.counts()} | incremental.apply(lake, mode == "full", new, sources.stores, sources.events)
    ingested, rejected = counts["raw_products"]["total"], counts["raw_products"]["malformed_records"]
    lake.log("quality_results", quality.checked(counts, _repeated_products(lake, "touched" in counts), spark, run_id, now))
    lake.log("metrics", runs.metric_rows(spark, {n: counts[n]["total"] for n in ("dim_product", "dim_store", "store_product_offers")}, run_id, now))
    if "touched" in counts:
        lake.log("metrics", runs.metric_rows(spark, {"products": counts["touched"]["total"]}, run_id, now, "touched"))
    if gated:
        quality.gate(lake["quality_results"].read().where(F.col("run_id") == run_id))
    # Only a run that passed moves the watermarks, and never back.
    lake["watermarks"].upsert(runs.watermarks(new, source, now), "wm_key", newer="watermark_ts")
    return ingested, rejected


def _repeated_products(lake: Lake, by_changes: bool) -> int:
    """Bar codes of dim_product with several rows; after changes only those touched can be new ones."""
    products = lake["dim_product"].matching(lake["touched"].read(), "barcode") if by_changes else lake["dim_product"].read()
    return quality.duplicates(products, "barcode").first().failed_count


def run(lake: Lake, sources: Sources, mode: str = "full", run_id: str | None = None, now: str | None = None, source: str = "openfoodfacts", gated: bool = False) -> str:
    """One run; returns its id. ``full`` replaces bronze and rebuilds, ``incremental`` adds what is past the watermarks
    and carries the changes to silver and gold; its stores and events are those that are new, and others among them have no effect. A failure is logged and raised again."""
    if mode not in ("full", "incremental"):
        raise ValueError(f"mode {mode}")
    run_id, started, clock = run_id or runs.new_run_id(), now or runs.utc_now(), time.monotonic()
    ingested = rejected = 0
    status = "failed"
    try:
        ingested, rejected = _ingest(lake, sources, mode, run_id, started, source, gated)
        status = "success"
    finally:
        lake.log("runs", runs.run_row(lake.spark, run_id, source, mode, started, now or runs.utc_now(), status, ingested, rejected, round(time.monotonic() - clock, 3)))
    return run_id


def maintain_lake(lake: Lake, cluster: dict[str, list[str]] | None = None) -> dict[str, dict[str, int]]:
    """Compacts the tables of all layers, and clusters those named. The rows of a key stay together, so that runs by changes go on reading few files."""
    by = incremental.DERIVED | {name: keys[-1] for name, (keys, _) in incremental.STATES.items()}
    return maintain({n: lake[n] for n in ("bronze_products", *by)}, cluster, by)


def export_marts(lake: Lake, folder: str, names: tuple[str, ...] = ("product_catalog", "cheapest_products", "category_price_stats", "product_search_index")) -> dict[str, str]:
    """Gold tables as plain Parquet folders for other readers."""
    paths = {n: f"{folder.rstrip('/')}/{n}" for n in names}
    for n, path in paths.items():
        lake[n].read().write.mode("overwrite").parquet(path)
    return paths
