"""Stored width of column types and rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Bytes per stored value, and for decimals per largest precision.
FIXED_BYTES = {
    "boolean": 1,
    "tinyint": 1,
    "smallint": 2,
    "int": 4,
    "float": 4,
    "date": 4,
    "bigint": 8,
    "double": 8,
    "timestamp": 8,
    "timestamp_ntz": 8,
}
DECIMAL_BYTES = [(9, 5), (19, 9), (28, 13), (38, 17)]


def fixed_width(data_type: T.DataType) -> int | None:
    """Bytes of one value, or None where it depends on the value."""
    if isinstance(data_type, T.DecimalType):
        return next(b for most, b in DECIMAL_BYTES if data_type.precision <= most)
    return FIXED_BYTES.get(data_type.simpleString())


def is_sized(data_type: T.DataType) -> bool:
    return isinstance(data_type, (T.StringType, T.BinaryType, T.CharType, T.VarcharType))


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def value_bytes(value: Column, data_type: T.DataType) -> Column:
    """Bytes of one value as a bigint: the fixed width of its type, the length of a text or
    binary (0 for NULL), and for nested types the sum of what is in them."""
    fixed, zero = fixed_width(data_type), F.lit(0).cast("long")
    if fixed is not None:
        return F.lit(fixed).cast("long")
    if is_sized(data_type):
        return F.coalesce(F.octet_length(value).cast("long"), zero)
    if isinstance(data_type, T.StructType):
        inside = [value_bytes(value.getField(f.name), f.dataType) for f in data_type.fields]
        return F.when(value.isNull(), zero).otherwise(reduce(lambda a, b: a + b, inside, zero))
    if isinstance(data_type, T.ArrayType):
        width = fixed_width(data_type.elementType)
        if width is not None:
            return F.coalesce(F.array_size(value).cast("long") * width, zero)
        summed = F.aggregate(value, zero, lambda total, v: total + value_bytes(v, data_type.elementType))
        return F.coalesce(summed, zero)
    if isinstance(data_type, T.MapType):
        keys = value_bytes(F.map_keys(value), T.ArrayType(data_type.keyType))
        return keys + value_bytes(F.map_values(value), T.ArrayType(data_type.valueType))
    # Of any other type no bytes can be told, so neither can those of the row.
    return F.lit(None).cast("long")


def row_bytes(df: DataFrame, columns: list[str] | None = None) -> Column:
    """Bytes of a row: the widths of its columns (see ``value_bytes``)."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    fixed = sum(fixed_width(f.dataType) or 0 for f in fields)
    sized = [value_bytes(quoted(f.name), f.dataType) for f in fields if fixed_width(f.dataType) is None]
    return reduce(lambda a, b: a + b, sized, F.lit(fixed).cast("long"))
