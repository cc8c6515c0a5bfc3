"""Fuzzy scores: token-sort ratio on the longest common subsequence.

The ratio of two texts is 2 * LCS / (their lengths' sum), after splitting on white space, sorting
the tokens and joining them by a space. ``token_sort_ratio`` is an expression; ``token_sort_ratio_arrow``
is the same for volume, in Arrow batches.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def sorted_tokens(text: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(text, r"\s+"), lambda t: t != "")), " ")


def lcs_length(a: Column, b: Column) -> Column:
    """Length of the longest common subsequence: one row of the table at a time, as an array."""
    chars_b = F.filter(F.split(b, ""), lambda c: c != "")

    def row(before: Column, c: Column) -> Column:
        def cell(acc: Column, j: Column) -> Column:
            here = F.element_at(chars_b, j)
            value = F.when(here == c, F.element_at(before, j) + 1).otherwise(F.greatest(F.element_at(before, j + 1), F.element_at(acc, -1)))
            return F.concat(acc, F.array(value))

        return F.when(F.size(chars_b) > 0, F.aggregate(F.sequence(F.lit(1), F.size(chars_b)), F.array(F.lit(0)), cell)).otherwise(F.array(F.lit(0)))

    zero = F.array_repeat(F.lit(0), F.size(chars_b) + 1)
    return F.element_at(F.aggregate(F.filter(F.split(a, ""), lambda c: c != ""), zero, row), -1)


def ratio(a: Column, b: Column) -> Column:
    total = F.length(a) + F.length(b)
    return F.when(total == 0, F.lit(1.0)).otherwise(F.lit(2.0) * lcs_length(a, b) / total)


def token_sort_ratio(a: Column, b: Column) -> Column:
    return ratio(sorted_tokens(a), sorted_tokens(b))


def _lcs(a: str, b: str) -> int:
    """Bit-parallel: bits of ``row`` are the columns of the table that don't grow."""
    if not a or not b:
        return 0
    masks: dict[str, int] = {}
    for k, c in enumerate(a):
        masks[c] = masks.get(c, 0) | 1 << k
    full = (1 << len(a)) - 1
    row = full
    for c in b:
        hit = row & masks.get(c, 0)
        row = ((row + hit) | (row - hit)) & full
    return len(a) - row.bit_count()


@F.pandas_udf(T.DoubleType())
def token_sort_ratio_arrow(a: pd.Series, b: pd.Series) -> pd.Series:
    def one(x: str | None, y: str | None) -> float | None:
        if x is None or y is None:
            return None
        p, q = (" ".join(sorted(t.split())) for t in (x, y))
        return 2.0 * _lcs(p, q) / (len(p) + len(q)) if p or q else 1.0

    return pd.Series([one(x, y) for x, y in zip(a, b)], dtype="float64")
