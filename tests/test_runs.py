"""End-to-end runs, carts, dead letters and the quality gate."""

import json

import pytest
from pyspark.sql import functions as F

from millrace.operators import pipeline, planner, quality, runs
from millrace.operators.tables import LakeTable
from millrace.plans import catalog
from millrace.plans import tables as t
from millrace.streaming import jobs
from tests.oracle import SF


def test_failed_run_is_logged_and_moves_no_watermark(spark, tmp_path):
    lake = pipeline.Lake(spark, f"file://{tmp_path}/lake")
    events = t.price_events(spark, SF).withColumn("price", F.lit(-1.0))
    with pytest.raises(quality.QualityGate, match="invalid_prices"):
        pipeline.run(lake, pipeline.Sources(t.raw_products(spark, SF).drop("ingested_at"), t.raw_stores(spark, SF), events), "full", "r1", "2024-01-01T00:00:00", gated=True)
    assert [(r.run_id, r.status) for r in lake["runs"].read().collect()] == [("r1", "failed")] and not lake["watermarks"].exists()
    assert lake["drift"].read().where("change = 'removed_column'").count() > 0
    with pytest.raises(ValueError):
        pipeline.run(lake, None, "weekly")


def test_runs_count_while_they_write(spark, tmp_path):
    """Checks and metrics equal those of a second pass, also where every check fails."""
    lake = pipeline.Lake(spark, f"file://{tmp_path}/lake")
    raw = t.raw_products(spark, SF).drop("ingested_at")
    events = t.price_events(spark, SF).withColumn("price", F.when(F.col("event_id").endswith("1"), -1.0).otherwise(F.col("price")))
    pipeline.run(lake, pipeline.Sources(raw, t.raw_stores(spark, SF), events), "full", "r1", "2024-01-01T00:00:00")
    tables = [lake[n].read() for n in ("bronze_products", "dim_product", "store_product_offers")]
    want = quality.run_checks(*tables, "r1", "2024-01-01T00:00:00").collect()
    got = lake["quality_results"].read().select(*want[0].asDict()).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and sum(r.failed_count for r in got) > 0
    metrics = runs.row_counts({n: lake[n].read() for n in ("dim_product", "dim_store", "store_product_offers")}, "r1", "2024-01-01T00:00:00")
    assert sorted(map(tuple, lake["metrics"].read().collect())) == sorted(map(tuple, metrics.collect()))
    log = lake["runs"].read().first()
    assert (log.rows_ingested, log.rows_rejected) == (raw.count(), lake["quarantine"].read().count())


def test_dead_letters_of_other_batches_of_one_number(spark, tmp_path):
    events, dead = LakeTable(spark, f"file://{tmp_path}/events"), LakeTable(spark, f"file://{tmp_path}/dead")
    batch = lambda *values: spark.createDataFrame([(v,) for v in values], "value string")
    sink = jobs.bronze_sink(events, dead)
    for values in (("{a", "{a", None), ("{b",), ("{a", "{a", None)):
        sink(batch(*values), 0)
    sink(batch("{a"), 1)
    assert sorted((r.batch_id, str(r.raw)) for r in dead.read().collect()) == [(0, "None"), (0, "{a"), (0, "{a"), (0, "{b"), (1, "{a")]


def test_upserting_sink_takes_the_newer_price(spark, tmp_path):
    events, dead = LakeTable(spark, f"file://{tmp_path}/events"), LakeTable(spark, f"file://{tmp_path}/dead")
    message = lambda price: json.dumps({"schema_version": 1, "event_id": 1, "store_id": 1, "product_id": 2, "price": price, "observed_at": "2024-01-01T00:00:00"})
    sink = jobs.bronze_sink(events, dead, update=True)
    for k, price in enumerate((1.5, 2.5, 2.5)):
        sink(spark.createDataFrame([(message(price),)], "value string"), k)
    assert [r.price for r in events.read().collect()] == [2.5]


def test_matching_reads_offers_that_are_written_once(spark):
    files = catalog.QUERIES["b2_x9_match"](spark, SF).inputFiles()
    assert files and not any("lineitem" in f for f in files)


def test_cart(spark):
    """Two near stores that together are worth a second visit; an item that none has; the explanation names the saving."""
    offers = spark.createDataFrame(
        [("a", 0.0, 0.0, "1", "rice", 90.0, True), ("a", 0.0, 0.0, "2", "milk", 1.0, True), ("b", 0.0, 0.01, "1", "rice", 2.0, True), ("b", 0.0, 0.01, "2", "milk", 60.0, True), ("c", 50.0, 50.0, "1", "rice", 0.1, True), ("a", 0.0, 0.0, "3", "tea", 1.0, False)],
        "store_id string, lat double, lon double, product_id string, product_name string, price double, in_stock boolean",
    ).withColumn("search_terms", F.lit(""))
    cart = spark.createDataFrame([("rice", 1), ("milk", 1), ("tea", 1)], "item string, qty int")
    answer = planner.optimize_cart(cart, offers, 0.0, 0.0, nearby=2)
    row = answer.recommendation.first()
    assert (row.recommended, row.multi_set) == ("multi_store", "a|b") and f"save {row.savings:.2f}" in row.explanation
    assert {r.item: r.store_id for r in answer.lines.collect()} == {"rice": "b", "milk": "a", "tea": None}
    assert {r.set_id: r.coverage for r in answer.costs.collect()} == {"": 0.0, "a": pytest.approx(1 / 3, abs=1e-4), "b": pytest.approx(1 / 3, abs=1e-4), "a|b": pytest.approx(2 / 3, abs=1e-4)}
    empty = planner.optimize_cart(cart.limit(0), offers, 0.0, 0.0, nearby=2)
    assert empty.lines.count() == 0 and {r.coverage for r in empty.costs.collect()} == {1.0}
