"""Structural drift: what changed between two schemas, at any depth, and which changes a table can take.

A change has the field's path (``a.b``, ``a[]`` for the elements of an array, ``a{key}`` and ``a{value}`` for those of a map), its kind, both types and a severity: ``info`` for
what a table can take (a new column, a wider type, what may be null by now), ``error`` for what it can't (a column gone, a type that doesn't fit).
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, ShortType, StructField, StructType, TimestampNTZType

CHANGES = "path string, change string, expected string, actual string, severity string"
#: Each type, and those that hold all its values and that Parquet readers read it as.
WIDER: dict[type, tuple[type, ...]] = {ByteType: (ShortType, IntegerType, LongType, DoubleType), ShortType: (IntegerType, LongType, DoubleType), IntegerType: (LongType, DoubleType), FloatType: (DoubleType,), DateType: (TimestampNTZType,)}


class SchemaMismatch(ValueError):
    """Rows that don't fit a table's schema."""


def widens(old: DataType, new: DataType) -> bool:
    """Whether every value of the old type is one of the new type."""
    if isinstance(old, DecimalType) and isinstance(new, DecimalType):
        return new.scale >= old.scale and new.precision - new.scale >= old.precision - old.scale
    return type(new) in WIDER.get(type(old), ())


def changes(old: DataType, new: DataType, path: str = "", old_null: bool = True, new_null: bool = True) -> Iterator[tuple[str, str, str | None, str | None, str]]:
    """(path, change, old type, new type, severity), in the order of the old schema's fields and then of the new one's."""
    names = old.simpleString(), new.simpleString()
    if isinstance(old, StructType) and isinstance(new, StructType):
        at = f"{path}." if path else ""
        for field in old.fields:
            if field.name in new.names:
                other = new[field.name]
                yield from changes(field.dataType, other.dataType, at + field.name, field.nullable, other.nullable)
            else:
                yield at + field.name, "removed_column", field.dataType.simpleString(), None, "error"
        for field in new.fields:
            if field.name not in old.names:
                yield at + field.name, "added_column", None, field.dataType.simpleString(), "info"
    elif isinstance(old, ArrayType) and isinstance(new, ArrayType):
        yield from changes(old.elementType, new.elementType, f"{path}[]", old.containsNull, new.containsNull)
    elif isinstance(old, MapType) and isinstance(new, MapType):
        yield from changes(old.keyType, new.keyType, f"{path}{{key}}", False, False)
        yield from changes(old.valueType, new.valueType, f"{path}{{value}}", old.valueContainsNull, new.valueContainsNull)
    elif old != new:
        wider, narrower = widens(old, new), widens(new, old)
        yield path, "widened_type" if wider else "narrowed_type" if narrower else "changed_type", *names, "info" if wider else "error"
    if new_null and not old_null:
        yield path, "became_nullable", *names, "info"


def drift(spark: SparkSession, expected: StructType, actual: StructType) -> DataFrame:
    """path, change, expected, actual, severity. Schemas are metadata, so the comparison is the driver's."""
    return spark.createDataFrame(list(changes(expected, actual)), CHANGES)


def _merged(old: DataType, new: DataType) -> DataType:
    """A type for the rows of both; those that fit one another only."""
    if isinstance(old, StructType) and isinstance(new, StructType):
        fields = [StructField(f.name, _merged(f.dataType, new[f.name].dataType) if f.name in new.names else f.dataType) for f in old.fields]
        return StructType(fields + [StructField(f.name, f.dataType) for f in new.fields if f.name not in old.names])
    if isinstance(old, ArrayType) and isinstance(new, ArrayType):
        return ArrayType(_merged(old.elementType, new.elementType))
    if isinstance(old, MapType) and isinstance(new, MapType):
        return MapType(_merged(old.keyType, new.keyType), _merged(old.valueType, new.valueType))
    return new if widens(old, new) else old


def widened(table: StructType, rows: StructType) -> StructType:
    """The schema of the table with such rows appended, or SchemaMismatch. Columns that rows lack are null there; narrower types are taken as the table's."""
    wrong = [f"{path}: {old} and {new}" for path, change, old, new, _ in changes(table, rows) if change == "changed_type"]
    if wrong:
        raise SchemaMismatch("; ".join(wrong))
    return _merged(table, rows)


def fitted(df: DataFrame, table: StructType) -> DataFrame:
    """The rows in the types of the table they will be part of, or SchemaMismatch."""
    schema = widened(table, df.schema)
    return df.select(*[F.col(f"`{c}`").cast(schema[c].dataType).alias(c) if df.schema[c].dataType != schema[c].dataType else F.col(f"`{c}`") for c in df.columns])
