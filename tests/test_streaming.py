import json
import time

import pytest

from millrace.operators.tables import LakeTable
from millrace.sources import files, generators
from millrace.sources.api import ProductSource, with_retry
from millrace.streaming import jobs, routing

V2 = {"schema_version": 2, "event_id": 1, "store_id": 1, "product_id": 2, "price": 1.5, "observed_at": "2024-01-01T00:00:00", "in_stock": False, "currency": "EUR"}
V1 = {k: v for k, v in V2.items() if k not in ("in_stock", "currency")} | {"schema_version": 1, "event_id": 2}
BAD = [
    json.dumps(V2 | {"price": -1}), json.dumps(V2 | {"price": 0}), json.dumps(V2 | {"price": True}), json.dumps(V2 | {"price": "4.5"}), json.dumps(V2 | {"price": None}), '{"schema_version":1,"event_id":1}',
    json.dumps(V2 | {"schema_version": 99}), "{not json", "[1]", "5", "", json.dumps(V2 | {"event_id": None}), None,
]


def routed(spark, values):
    return routing.route(spark.createDataFrame([(v,) for v in values], "value string"))


def test_routes(spark):
    ok = routing.accepted(routed(spark, [json.dumps(V2), json.dumps(V1)])).orderBy("event_id").collect()
    assert [(r.event_id, r.schema_version, r.in_stock, r.currency) for r in ok] == [(1, 2, False, "EUR"), (2, 2, True, "USD")]
    dead = routed(spark, BAD)
    assert dead.where("route = 'ok'").count() == 0 and routing.dead_letters(dead).count() == len(BAD)


def test_late_flags(spark):
    rows = spark.createDataFrame([(1, 1000.0), (2, 1100.0), (3, 1000.0), (4, 1040.0)], "o long, s double")
    for groups in (None, ["g"]):
        df = rows.withColumn("g", rows.o * 0) if groups else rows
        got = routing.late_in_order(df, "o", 60, seconds=df.s, groups=groups).orderBy("o").collect()
        assert [r._late for r in got] == [False, False, True, False]


def test_late_flags_by_parts_of_seconds_and_in_a_total_order(spark, tmp_path):
    """An hour less a tenth of a second behind is in time, an hour and a tenth is late; event 1,000,005 has the place of event 2 in the order and comes after it."""
    from millrace.plans import catalog
    from tests.oracle import duck

    times = [(0, "2024-01-01 10:00:00.9"), (2, "2024-01-01 12:00:00.95"), (1_000_005, "2024-01-01 11:00:00.9"), (700_000, "2024-01-01 11:00:00.99")]
    spark.createDataFrame(times, "event_id long, ts string").selectExpr("event_id", "ts::timestamp_ntz AS ts").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = {r.event_id: r.late for r in catalog.w5_t4_late_flags(spark, str(tmp_path)).collect()}
    assert got == {0: False, 2: False, 1_000_005: True, 700_000: False}
    once = duck(catalog.ORACLES["w5_t4_late_flags"].replace("FROM events", "FROM events WHERE event_id < 1000003"), str(tmp_path))
    assert {k: v for k, v in got.items() if k < 1_000_003} == dict(zip(once.event_id, once.late))


def test_thirds_equal_ntile(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from millrace.plans import catalog

    for n in (1, 2, 4, 8, 9):
        rows = spark.range(n).select((F.col("id") * 50_021 + 7).alias("event_id"))
        want = rows.withColumn("batch", F.ntile(3).over(Window.orderBy("event_id"))).collect()
        assert sorted(map(tuple, catalog._thirds(rows, n).select("event_id", "batch").collect())) == sorted(map(tuple, want)), n


def test_batches_of_several_files(spark, monkeypatch):
    """No file takes a whole batch, and the result is the SQL's."""
    from millrace.plans import catalog
    from tests.oracle import same

    monkeypatch.setattr(catalog, "FILE_ROWS", 100)
    name = "t4_t5_watermarked_stream"
    same(spark, catalog.QUERIES[name], catalog.ORACLES[name])


def test_stream_to_bronze_twice(spark, tmp_path):
    lines = [json.dumps(V2), json.dumps(V2), json.dumps(V1), "{not json"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(str(tmp_path / "in"))
    bronze, dead = LakeTable(spark, f"file://{tmp_path}/bronze"), LakeTable(spark, f"file://{tmp_path}/dead")
    for k in range(2):
        jobs.start_bronze(jobs.file_messages(spark, str(tmp_path / "in")), bronze, dead, str(tmp_path / f"c{k}"), update=bool(k), once=True).awaitTermination()
    assert sorted(r.event_id for r in bronze.read().collect()) == [1, 2]
    assert dead.read().count() == 1
    assert files.replay_dead_letters(dead.read()).first().value == "{not json"


def test_stateful_late_flags(spark, tmp_path):
    path = str(tmp_path / "in")
    spark.createDataFrame([(json.dumps(V2 | {"event_id": k, "observed_at": f"2024-01-01T{h:02d}:00:00"}),) for k, h in ((1, 1), (2, 5), (3, 2))], "value string").coalesce(1).write.text(path)
    events = routing.accepted(routing.route(jobs.file_messages(spark, path)))
    jobs.late_flags(events).writeStream.format("memory").queryName("late").option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start().awaitTermination()
    assert {r.event_id: r._late for r in spark.table("late").collect()} == {1: False, 2: False, 3: True}


def test_watermarks_drop_and_states_expire(spark, tmp_path):
    """Batches of one file each: a copy, a late event, one later than the watermark, and keys that go quiet."""
    path = str(tmp_path / "in")
    batches = [
        [(1, 1, "10:00"), (2, 2, "10:05"), (1, 1, "10:00")],
        [(3, 1, "13:00"), (1, 1, "10:00"), (4, 3, "10:10")],
        [(5, 1, "12:20"), (6, 1, "11:50"), (3, 1, "13:00"), (7, 2, "09:00")],
        [(8, 1, "16:00"), (9, 4, "11:00")],
    ]
    for rows in batches:
        message = lambda k, store, at: json.dumps(V2 | {"event_id": k, "store_id": store, "observed_at": f"2024-01-01T{at}:00"})
        spark.createDataFrame([(message(*r),) for r in rows], "value string").coalesce(1).write.mode("append").text(path)
        time.sleep(0.05)
    on_time, late = LakeTable(spark, f"file://{tmp_path}/on_time"), LakeTable(spark, f"file://{tmp_path}/late")
    query = jobs.start_flagged(jobs.file_messages(spark, path, 1), on_time, late, str(tmp_path / "c"), delay="1 hour", lateness=1800.0, once=True)
    query.awaitTermination()
    ids = lambda table: sorted(r.event_id for r in table.read().collect())
    # Rows are dropped by the watermark of the batch before: 09:05 for the third, 12:00 for the fourth.
    assert (ids(on_time), ids(late)) == ([1, 2, 3, 4, 8], [5, 6])
    states = [[op.numRowsTotal for op in p.stateOperators] for p in query.recentProgress]
    assert sum(op.numRowsDroppedByWatermark for p in query.recentProgress for op in p.stateOperators) == 2
    assert states[-1] == [1, 1]


def test_publishing(spark, tmp_path):
    good = routing.accepted(routed(spark, [json.dumps(V2)]))
    jobs.publish(good, str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="invalid"):
        routing.to_message(good.withColumn("price", F.lit(-5.0))).collect()


def test_sources(spark, tmp_path):
    folder = tmp_path / "milk"
    folder.mkdir()
    page = lambda *items: json.dumps({"products": [{"code": f" {c}", "product_name": "Milk", "last_modified_t": t} for c, t in items]})
    (folder / "1.json").write_text(page((1, 10), (2, 20)))
    (folder / "2.json").write_text(page((3, 30)))
    (tmp_path / "rice").mkdir()
    (tmp_path / "rice" / "1.json").write_text("{broken")
    source = ProductSource(str(tmp_path), {"milk": "Milks", "rice": "Rices"}, page_size="2", max_pages="5", delay_s="0")
    assert sorted(r.barcode for r in source.fetch(spark, {}).collect()) == ["1", "2", "3"]
    assert sorted(r.barcode for r in source.fetch(spark, {"milk": 20}).collect()) == ["3"]
    # A failed page, or more pages than asked for, leaves the whole category for the next run.
    (folder / "2.json").write_text(page((3, 30), (4, 40)))
    (folder / "3.json").write_text("{broken")
    assert source.fetch(spark, {}).count() == 0
    (folder / "3.json").write_text(page((5, 5)))
    assert source.fetch(spark, {}).count() == 5
    few = ProductSource(str(tmp_path), {"milk": "Milks"}, page_size="2", max_pages="2", delay_s="0")
    assert few.fetch(spark, {}).count() == 0
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError

    with pytest.raises(OSError):
        with_retry(fails, 1.0, sleep=waits.append)
    assert len(calls) == 4 and waits == [1.0, 2.0, 4.0]


def test_generators_repeat(spark):
    a, b = (generators.scale_events(spark, 1000, partitions=p).orderBy("event_id").collect() for p in (1, 5))
    assert a == b
    counts = {r.route: r.n for r in routing.counts(routing.route(generators.demo_messages(spark, 300))).collect()}
    assert counts["ok"] + counts["dlq"] == 310 and 10 < counts["dlq"] < 60
    assert generators.modelled_stores(spark).count() == 8


def test_replay(spark):
    log = spark.createDataFrame([(1, "a", "x"), (5, "b", "y"), (9, "c", "z")], "ts_ms long, key string, value string")
    assert [r.value for r in files.replay_from(log, 5).collect()] == ["y", "z"]
    assert files.replay_from(log, 0, 2).count() == 2
