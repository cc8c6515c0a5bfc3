"""Places in a global order, without a task that holds the whole of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import staged


def numbered(rows: DataFrame, order: list[Column], tree: str | None = None, name: str = "numbered") -> DataFrame:
    """The rows with ``place``, counted from 0 in the order, within each value of ``tree`` if given (never null); the table is staged.

    Rows are dealt out by ranges of the order and sorted there, so equal keys of any number are no hot spot as long as the order tells rows apart;
    a part's first place comes from the number of rows in earlier parts: one row for each part and tree.
    """
    keys = [tree] if tree else []
    spread = [*[F.col(k) for k in keys], *order]
    ordered = rows.repartitionByRange(*spread).sortWithinPartitions(*spread).withColumn("_id", F.monotonically_increasing_id())
    ordered = staged(ordered.withColumn("_part", F.shiftright("_id", 33)), name)
    parts = ordered.groupBy(*keys, "_part").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(*keys, *([] if keys else [F.lit(0)])).orderBy("_part")) - F.col("_n")
    starts = parts.select(*keys, "_part", (before - F.col("_first")).alias("_shift"))
    return ordered.join(starts, [*keys, "_part"]).withColumn("place", F.col("_id") + F.col("_shift")).drop("_id", "_part", "_shift")
