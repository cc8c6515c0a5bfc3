"""Text kernels on columns: quantities, search terms, white space and pipe-joined lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Canonical unit and factor of each unit of measure.
UNITS = {
    "kg": ("g", 1000.0), "g": ("g", 1.0), "mg": ("g", 0.001), "l": ("ml", 1000.0), "ml": ("ml", 1.0), "cl": ("ml", 10.0),
    "oz": ("g", 28.3495), "lb": ("g", 453.592), "floz": ("ml", 29.5735),
}
QUANTITY = r"(\d+(?:\.\d+)?)\s*(fl\s*oz|floz|kg|mg|cl|ml|oz|lb|g|l)\b"
MAX_TERMS = 10


def half_up(x: Column, digits: int = 2) -> Column:
    """Rounding that is the same expression, and so the same result, in any SQL engine."""
    scale = float(10**digits)
    return F.floor(x * F.lit(scale) + F.lit(0.5)) / F.lit(scale)


def quantity_value(quantity: Column) -> Column:
    """The first amount in free text, in grams or millilitres; null where there is none."""
    amount = F.nullif(F.regexp_extract(F.lower(quantity), QUANTITY, 1), F.lit("")).cast("double")
    return half_up(amount * _by_unit(quantity, 1))


def quantity_unit(quantity: Column) -> Column:
    """``g`` or ``ml``, or null."""
    return _by_unit(quantity, 0)


def _by_unit(quantity: Column, field: int) -> Column:
    unit = F.replace(F.regexp_extract(F.lower(quantity), QUANTITY, 2), F.lit(" "), F.lit(""))
    out = F.when(F.lit(False), F.lit(None))
    for name, canon in UNITS.items():
        out = out.when(unit == name, F.lit(canon[field]))
    return out


def squeeze(text: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def is_ascii(text: Column) -> Column:
    return ~text.rlike(r"[^\x00-\x7F]")


def tokens(text: Column) -> Column:
    """Lower-cased runs of ASCII letters and digits of two characters at least."""
    return F.filter(F.regexp_extract_all(F.lower(text), F.lit("([a-z0-9]+)"), 1), lambda t: F.length(t) > 1)


def search_terms(name: Column, brand: Column, term: Column, exclude: Column) -> Column:
    """The category's term, unless the name holds a word of ``exclude``, then the name's and brand's tokens: distinct, in order, at most ten, pipe-joined."""
    excluded = F.exists(F.coalesce(exclude, F.array().cast("array<string>")), lambda x: F.contains(F.lower(name), x))
    words = F.filter(tokens(F.concat_ws(" ", name, F.coalesce(brand, F.lit("")))), lambda t: t != term)
    first = F.when(excluded, F.array().cast("array<string>")).otherwise(F.array(term))
    return F.array_join(F.slice(F.array_distinct(F.concat(first, words)), 1, MAX_TERMS), "|")


def raw_terms(name: Column, term: Column, plain: Column) -> Column:
    """The name's words, pipe-joined, after the category's term where ``plain`` holds; neither distinct nor capped."""
    words = F.lower(F.regexp_replace(F.trim(name), r"\s+", "|"))
    return F.when(plain, F.concat(term, F.lit("|"), words)).otherwise(words)


def split_terms(joined: Column) -> Column:
    return F.filter(F.split(joined, r"\|"), lambda t: t != "")


def join_tags(tags: Column) -> Column:
    """A list as pipe-joined text; a null list is empty text."""
    return F.coalesce(F.array_join(tags, "|"), F.lit(""))
