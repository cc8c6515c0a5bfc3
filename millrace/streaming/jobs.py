"""Structured Streaming jobs from messages to bronze, with dead letters, checkpoints and idempotent sinks.

A stream of messages has a ``value`` column; ``kafka_messages`` and ``file_messages`` give one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from millrace.functions.events import event_seconds
from millrace.operators.tables import LakeTable
from millrace.streaming.routing import ALLOWED_LATENESS, accepted, dead_letters, route


def kafka_messages(spark: SparkSession, servers: str, topic: str, starting: str = "earliest", max_offsets: int | None = None) -> DataFrame:
    """Needs the Kafka connector on the class path."""
    reader = spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting)
    return (reader.option("maxOffsetsPerTrigger", max_offsets) if max_offsets else reader).load().selectExpr("CAST(key AS STRING) AS key", "value")


def file_messages(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """One message a line of text files; new files are new messages."""
    return spark.readStream.option("maxFilesPerTrigger", max_files).text(path)


def parsed(messages: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Accepted events with event_ts, event_date and a watermark on event_ts; unreadable times are null instead of failing the query."""
    events = accepted(route(messages))
    stamped = events.withColumn("event_ts", F.try_to_timestamp(F.replace("observed_at", F.lit("Z"), F.lit("")))).withColumn("event_date", F.to_date("event_ts"))
    return stamped.withWatermark("event_ts", delay)


def with_times(events: DataFrame) -> DataFrame:
    stamped = events.withColumn("event_ts", F.try_to_timestamp(F.replace("observed_at", F.lit("Z"), F.lit(""))))
    return stamped.withColumn("event_date", F.to_date("event_ts"))


def bronze_sink(events: LakeTable, dead: LakeTable, update: bool = False, source: str = "") -> Callable[[DataFrame, int], None]:
    """A foreachBatch function: accepted events are inserted (or upserted) by event_id, the rest goes to the dead letters.

    Running a batch again leaves both tables as they were, so at-least-once delivery has effects once. A dead letter is told
    by source, batch, content and its number among equal ones of the batch: other messages of a batch of the same
    number, as after a restart with a new checkpoint, are letters of their own. Streams that share a table need different ``source`` names.
    """

    def sink(batch: DataFrame, batch_id: int) -> None:
        routed = route(batch).persist()
        try:
            rows = with_times(accepted(routed))
            order = [F.desc_nulls_last("event_ts"), F.struct(*[F.col(c) for c in rows.columns]).desc()]
            if update:
                events.upsert(rows, "event_id", order, ["event_date"])
            else:
                events.insert_new(rows, "event_id", order, ["event_date"])
            letters = dead_letters(routed).withColumns({"source": F.lit(source), "batch_id": F.lit(batch_id)})
            content = F.sha2(F.to_json(F.struct("source", "batch_id", "error", "raw")), 256)
            number = F.row_number().over(Window.partitionBy("_content").orderBy("dlq_at"))
            letters = letters.withColumn("_content", content).withColumn("letter_id", F.concat_ws("-", "_content", number)).drop("_content")
            dead.insert_new(letters, "letter_id")
        finally:
            routed.unpersist()

    return sink


def start_bronze(messages: DataFrame, events: LakeTable, dead: LakeTable, checkpoint: str, update: bool = False, once: bool = False, source: str = "") -> StreamingQuery:
    """The stream of messages into bronze; offsets are committed after the sink returns."""
    writer = messages.writeStream.foreachBatch(bronze_sink(events, dead, update, source)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def publish(events: DataFrame, path: str, checkpoint: str | None = None) -> StreamingQuery | None:
    """Validated messages as JSON lines; events of one store go to one file. A stream needs a checkpoint."""
    from millrace.streaming.routing import to_message

    messages = to_message(events).repartition("key").select("value")
    if messages.isStreaming:
        return messages.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    messages.write.mode("append").text(path)
    return None


def watermarked(events: DataFrame, delay: str = "1 hour") -> DataFrame:
    """Accepted events with event_ts, each event_id once: later copies within the delay are dropped, and so is what is later than the watermark; states expire with it."""
    stamped = events if "event_ts" in events.columns else with_times(events)
    return stamped.withWatermark("event_ts", delay).dropDuplicatesWithinWatermark(["event_id"])


def late_flags(events: DataFrame, key: str = "store_id", lateness: float = ALLOWED_LATENESS) -> DataFrame:
    """The events with _late, on a stream: lateness against the greatest event time that the key's state has seen.

    Each key has its own state, so that the stream is dealt out by key; a constant key gives one order for all. A key's state expires when the watermark passes that
    time: what comes later is dropped or newer, so nothing is flagged otherwise. Events without a watermark get one of ``lateness``.
    """
    stamped = events if "event_ts" in events.columns else with_times(events).withWatermark("event_ts", f"{int(lateness)} seconds")
    columns = [c for c in stamped.columns if c != "_t"]
    fields = ", ".join(f"`{c}` {stamped.schema[c].dataType.simpleString()}" for c in columns) + ", _late boolean"

    def flag(_: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        (top,) = state.get if state.exists else (0.0,)
        for rows in batches:
            late = []
            for t in rows["_t"]:
                late.append(top > 0 and t < top - lateness)
                top = max(top, t)
            yield rows.assign(_late=late)[[*columns, "_late"]]
        state.update((top,))
        state.setTimeoutTimestamp(max(int(top * 1000), state.getCurrentWatermarkMs()) + 1)

    return stamped.withColumn("_t", event_seconds(F.col("observed_at"))).groupBy(key).applyInPandasWithState(flag, fields, "top double", "append", GroupStateTimeout.EventTimeTimeout)


def start_flagged(messages: DataFrame, on_time: LakeTable, late: LakeTable, checkpoint: str, delay: str = "1 hour", lateness: float = ALLOWED_LATENESS, once: bool = False) -> StreamingQuery:
    """The stream of messages, each event once, into a table of events in time and a side table of late ones. What is later than the watermark is dropped; the query's progress
    tells how many (``numRowsDroppedByWatermark``) and how many states are held."""

    def sink(batch: DataFrame, _: int) -> None:
        rows = batch.persist()
        try:
            for table, flag in ((on_time, False), (late, True)):
                table.insert_new(rows.where(F.col("_late") == flag).drop("_late"), "event_id")
        finally:
            rows.unpersist()

    flagged = late_flags(watermarked(accepted(route(messages)), delay), lateness=lateness)
    writer = flagged.writeStream.foreachBatch(sink).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
