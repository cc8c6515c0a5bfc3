"""Bar codes: digits, structure and check digit."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LENGTHS = (8, 12, 13, 14)


def digits(code: Column) -> Column:
    return F.regexp_replace(code, "[^0-9]", "")


def has_gtin_length(code: Column) -> Column:
    return F.coalesce(F.length(digits(code)).isin(*LENGTHS), F.lit(False))


def valid_gtin(code: Column) -> Column:
    """Right length and check digit (mod 10, weights 3 and 1 from the right). Null is not valid."""
    padded = F.lpad(digits(code), 14, "0")
    weighted = [F.substring(padded, k, 1).cast("int") * F.lit(3 if k % 2 else 1) for k in range(1, 14)]
    check = F.pmod(F.lit(10) - sum(weighted[1:], weighted[0]) % 10, F.lit(10))
    return F.when(has_gtin_length(code), check == F.substring(padded, 14, 1).cast("int")).otherwise(F.lit(False))
