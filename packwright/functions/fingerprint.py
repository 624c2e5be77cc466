"""An order-free fingerprint of rows, from typed columns and JVM-side expressions only.

One 64-bit hash per row, summed exactly. A sum and not an xor, so that doubled rows show. `xxhash64`
skips NULLs, takes -0.0 for 0.0 and refuses maps; flags and entry lists put those back.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from packwright.functions.columns import named

_HASHED_AS_IS = (
    T.BooleanType,
    T.ByteType,
    T.ShortType,
    T.IntegerType,
    T.LongType,
    T.DecimalType,
    T.DateType,
    T.TimestampType,
    T.TimestampNTZType,
    T.BinaryType,
    T.DayTimeIntervalType,
    T.YearMonthIntervalType,
)


def _parts(value: Column, dtype: T.DataType) -> list[Column]:
    """The columns whose hash identifies one value, with a flag that tells NULL from absent."""
    if isinstance(dtype, T.StructType):
        fields = [p for f in dtype.fields for p in _parts(value.getField(f.name), f.dataType)]
        return [value.isNull(), *fields]
    if isinstance(dtype, T.MapType):
        entry = T.StructType(
            [T.StructField("key", dtype.keyType), T.StructField("value", dtype.valueType)]
        )
        return _parts(F.map_entries(value), T.ArrayType(entry))
    if isinstance(dtype, T.ArrayType):
        items = F.transform(value, lambda item: F.xxhash64(*_parts(item, dtype.elementType)))
        return [value.isNull(), F.coalesce(F.array_size(value), F.lit(-1)), items]
    if isinstance(dtype, (T.FloatType, T.DoubleType)):
        minus_zero = F.when(value == 0, value.cast("string") == "-0.0").otherwise(False)
        return [value.isNull(), value, minus_zero]
    if isinstance(dtype, T.StringType):
        return [value.isNull(), value.cast("binary")]
    if isinstance(dtype, _HASHED_AS_IS):
        return [value.isNull(), value]
    return [value.isNull(), value.cast("string")]


def row_hash(schema: T.StructType) -> Column:
    """A 64-bit hash of all columns of a row."""
    parts = [p for f in schema.fields for p in _parts(named(f.name), f.dataType)]
    return F.xxhash64(*parts) if parts else F.lit(0).cast("bigint")


def hash_sums(row_hash_column: str) -> list[Column]:
    """Partial sums of a hash column in three parts, none of which can overflow below 2**42 rows."""
    h = F.col(row_hash_column)
    low = (1 << 21) - 1
    return [
        F.sum(h.bitwiseAND(F.lit(low))).alias("sum_low"),
        F.sum(F.shiftrightunsigned(h, 21).bitwiseAND(F.lit(low))).alias("sum_mid"),
        F.sum(F.shiftrightunsigned(h, 42)).alias("sum_high"),
    ]


def combined_sum() -> Column:
    """The exact sum of the unsigned hashes, as text."""
    wide = T.DecimalType(38, 0)
    step = F.lit(1 << 21).cast(T.DecimalType(8, 0))
    high = F.col("sum_high").cast(T.DecimalType(20, 0))
    mid = F.col("sum_mid").cast(T.DecimalType(20, 0))
    low = F.col("sum_low").cast(T.DecimalType(20, 0))
    upper = ((high * step).cast(T.DecimalType(28, 0)) + mid).cast(T.DecimalType(29, 0))
    return ((upper * step).cast(wide) + low).cast(wide).cast("string")
