"""Time and JSON kernels of price events."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def event_seconds(observed_at: Column) -> Column:
    """Epoch seconds of an ISO time, a Z taken off; 0 where it can't be read."""
    return F.coalesce(F.unix_micros(F.try_to_timestamp(F.replace(observed_at, F.lit("Z"), F.lit("")))) / F.lit(1e6), F.lit(0.0))


def event_date(observed_at: Column) -> Column:
    return F.substring(observed_at, 1, 10)


def inventory_key(store_id: Column, barcode: Column) -> Column:
    return F.concat(store_id, F.lit("|"), barcode)


def positive(x: Column) -> Column:
    """False for null, zero and negative numbers."""
    return F.coalesce(x > 0, F.lit(False))
