"""Modelled prices: a deterministic base price, and hash-derived uniform draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from millrace.functions.gtin import digits
from millrace.functions.text import half_up


def base_price(base: Column, code: Column) -> Column:
    """The category's price times 0.85 to 1.15, by the code's last four digits."""
    last = F.coalesce(F.nullif(F.right(digits(code), F.lit(4)), F.lit("")).cast("int"), F.lit(0))
    return half_up(base * (F.lit(0.85) + (last % 31) / F.lit(100.0)))


def uniform(seed: int, *columns: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """A draw in [low, high) that depends on the columns and the seed alone, so it is the same on any partitioning."""
    draw = F.pmod(F.xxhash64(*columns, F.lit(seed)), F.lit(1 << 31)) / F.lit(float(1 << 31))
    return F.lit(low) + draw * F.lit(high - low)
