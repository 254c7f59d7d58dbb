"""Column types: logical widths that Spark lacks live in field metadata under `logical`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarryframe.errors import ColumnNotFound, TypeNotNumeric

#: Logical types stored in a wider or plainer Spark type.
STORED: dict[str, T.DataType] = {
    "u8": T.ShortType(),
    "u16": T.IntegerType(),
    "u32": T.LongType(),
    "u64": T.DecimalType(20, 0),
    "i128": T.DecimalType(38, 0),
    "u128": T.DecimalType(38, 0),
    "usize": T.LongType(),
    "isize": T.LongType(),
    "f16": T.FloatType(),
    "time": T.LongType(),
    "uuid": T.StringType(),
    "fixed_bytes": T.BinaryType(),
    "raw": T.BinaryType(),
    "interval": T.StructType([T.StructField(n, T.LongType()) for n in ("months", "days", "millis")]),
}
_NATIVE = {T.BooleanType: "bool", T.ByteType: "i8", T.ShortType: "i16", T.IntegerType: "i32", T.LongType: "i64", T.FloatType: "f32", T.DoubleType: "f64", T.StringType: "string", T.DateType: "date", T.TimestampType: "timestamp", T.TimestampNTZType: "timestamp", T.DecimalType: "decimal", T.BinaryType: "binary", T.ArrayType: "nested", T.MapType: "nested", T.StructType: "nested"}

SIGNED = {"i8": 8, "i16": 16, "i32": 32, "i64": 64, "i128": 128, "isize": 64}
UNSIGNED = {"u8": 8, "u16": 16, "u32": 32, "u64": 64, "u128": 128, "usize": 64}
#: Explicit mantissa bits.
FLOATS = {"f16": 10, "f32": 23, "f64": 52}
NUMERIC = {*SIGNED, *UNSIGNED, *FLOATS}
CASTABLE = NUMERIC | {"bool", "string"}


def label(field: T.StructField) -> str:
    """The logical type's name."""
    return (field.metadata or {}).get("logical") or _NATIVE.get(type(field.dataType), field.dataType.simpleString())


def field_of(df: DataFrame, name: str) -> T.StructField:
    for field in df.schema.fields:
        if field.name == name:
            return field
    raise ColumnNotFound(f"no column {name!r}; there are {df.columns}")


def numeric(df: DataFrame, name: str) -> T.StructField:
    """The column's field; decimals count as numeric too, a superset."""
    field = field_of(df, name)
    if label(field) not in NUMERIC and not isinstance(field.dataType, T.DecimalType):
        raise TypeNotNumeric(f"{name!r} is {label(field)}")
    return field


def is_float(field: T.StructField) -> bool:
    return isinstance(field.dataType, (T.FloatType, T.DoubleType))


def bounds(name: str) -> tuple[int, int]:
    """Least and largest value of an integer type; 128-bit types are cut to 38 digits."""
    if name in SIGNED:
        bits = SIGNED[name]
        low, high = -(1 << bits - 1), (1 << bits - 1) - 1
    else:
        low, high = 0, (1 << UNSIGNED[name]) - 1
    top = 10**38 - 1
    return max(low, -top), min(high, top)


def stored(name: str) -> T.DataType:
    """The Spark type that holds a logical type."""
    if name in STORED:
        return STORED[name]
    plain = {"bool": T.BooleanType(), "i8": T.ByteType(), "i16": T.ShortType(), "i32": T.IntegerType(), "i64": T.LongType(), "f32": T.FloatType(), "f64": T.DoubleType(), "string": T.StringType(), "date": T.DateType(), "timestamp": T.TimestampType(), "binary": T.BinaryType()}
    return plain[name]


def metadata(name: str) -> dict:
    return {"logical": name} if name in STORED else {}


def safe_cast(source: str, target: str) -> bool:
    """Whether every value of source has its place in target."""
    if source == target or target == "string":
        return True
    if source == "bool":
        return target in NUMERIC
    if source in FLOATS:
        return target in FLOATS and FLOATS[target] >= FLOATS[source]
    if source in SIGNED:
        return SIGNED.get(target, 0) >= SIGNED[source] or FLOATS.get(target, 0) >= SIGNED[source]
    if source in UNSIGNED:
        return UNSIGNED.get(target, 0) >= UNSIGNED[source] or SIGNED.get(target, 0) > UNSIGNED[source] or FLOATS.get(target, 0) >= UNSIGNED[source]
    return False
