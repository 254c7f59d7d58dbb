"""Column helpers for dates, times, timestamps, decimals, UUIDs, intervals, bytes and nested values.

Times are nanoseconds since midnight (bigint).  Intervals are structs of months, days and millis.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

UNITS = {"millis": 1_000_000, "micros": 1_000, "nanos": 1}


# dates
def date_from_civil(year: Column, month: Column, day: Column) -> Column:
    return F.make_date(year, month, day)


def date_parts(c: Column) -> Column:
    return F.struct(F.year(c).alias("year"), F.month(c).alias("month"), F.day(c).alias("day"))


def date_add_days(c: Column, n: Column | int) -> Column:
    return F.date_add(c, n)


def date_diff_days(a: Column, b: Column) -> Column:
    return F.date_diff(a, b)


def date_format(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd")


# times
def time_from(value: Column, unit: str) -> Column:
    return value.cast("long") * F.lit(UNITS[unit])


def time_hour(c: Column) -> Column:
    return F.floor(c / F.lit(3_600_000_000_000)).cast("int")


def time_minute(c: Column) -> Column:
    return (F.floor(c / F.lit(60_000_000_000)) % 60).cast("int")


def time_second(c: Column) -> Column:
    return (F.floor(c / F.lit(1_000_000_000)) % 60).cast("int")


def time_add(c: Column, nanos: Column | int, unit: str = "nanos") -> Column:
    """Later by nanos, without a turn at midnight; what the unit can't hold raises."""
    n = F.lit(nanos) if isinstance(nanos, int) else nanos
    return F.when(n % UNITS[unit] != 0, F.raise_error(F.lit("duration finer than the unit"))).otherwise(c + n).cast("long")


def time_format(c: Column, digits: int = 9) -> Column:
    fraction = F.substring(F.lpad((c % 1_000_000_000).cast("string"), 9, "0"), 1, digits)
    return F.concat_ws(":", *(F.lpad(f(c).cast("string"), 2, "0") for f in (time_hour, time_minute)), F.concat(F.lpad(time_second(c).cast("string"), 2, "0"), F.lit("."), fraction))


# timestamps
def timestamp_add(c: Column, micros: Column | int) -> Column:
    n = F.lit(micros) if isinstance(micros, int) else micros
    return F.timestamp_add("MICROSECOND", n, c)


def timestamp_date(c: Column) -> Column:
    return F.to_date(c)


def timestamp_time(c: Column) -> Column:
    """Nanoseconds since midnight, floored before 1970 too."""
    return ((F.hour(c) * 3600 + F.minute(c) * 60).cast("long") * 1_000_000_000 + (F.date_format(c, "ss").cast("long") * 1_000_000 + F.date_format(c, "SSSSSS").cast("long")) * 1_000).cast("long")


def timestamp_from(date: Column, time: Column) -> Column:
    return F.timestamp_add("MICROSECOND", F.floor(time / 1000).cast("long"), date.cast("timestamp_ntz"))


def timestamp_format(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


# decimals
def decimal_rescale(c: Column, precision: int, scale: int) -> Column:
    """The same value at another scale; one that would lose digits raises."""
    moved = c.try_cast(T.DecimalType(precision, scale))
    return F.when(c.isNull(), None).when(moved == c, moved).otherwise(F.raise_error(F.lit("lossy rescale")))


def _decimal(c: Column, precision: int, scale: int) -> Column:
    return F.when(c.isNull(), None).otherwise(F.coalesce(c.try_cast(T.DecimalType(precision, scale)), F.raise_error(F.lit("decimal overflow"))))


def decimal_add(a: Column, b: Column, precision: int, scale: int) -> Column:
    """a + b at the given precision and scale, the larger of the operands' scales; what they can't hold raises."""
    return _decimal(a + b, precision, scale)


def decimal_sub(a: Column, b: Column, precision: int, scale: int) -> Column:
    """a - b, as decimal_add."""
    return _decimal(a - b, precision, scale)


def decimal_mul(a: Column, b: Column, precision: int, scale: int) -> Column:
    """a * b at the given precision and scale, the sum of the operands' scales; what they can't hold raises."""
    return _decimal(a * b, precision, scale)


def decimal_div(a: Column, b: Column, scale: int, scale_a: int, scale_b: int) -> Column:
    """a / b at a scale, cut toward zero; division by zero raises, and so does a scale that can't be met.

    Scales are the operands'.  Unscaled integers are divided, so the result is exact.
    """
    up = scale + scale_b - scale_a
    if up < 0:
        raise ValueError("lossy rescale")
    x = (a * F.lit(10**scale_a).cast("decimal(38,0)")).cast("decimal(38,0)") * F.lit(10**up).cast("decimal(38,0)")
    y = (b * F.lit(10**scale_b).cast("decimal(38,0)")).cast("decimal(38,0)")
    x = x.cast("decimal(38,0)")
    whole = ((x - x % y) / y).cast("decimal(38,0)")
    return (whole / F.lit(10**scale).cast("decimal(38,0)")).cast(T.DecimalType(38, scale))


def decimal_to_float(c: Column) -> Column:
    return c.cast("double")


def decimal_from_float(c: Column, precision: int, scale: int) -> Column:
    return F.when(F.isnan(c) | (F.abs(c) == float("inf")), F.raise_error(F.lit("not finite"))).otherwise(c).cast(T.DecimalType(precision, scale))


# UUIDs: canonical lower-case strings, whose order is that of the bytes
_UUID = r"(?i)^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def uuid_parse(c: Column) -> Column:
    return F.when(c.isNull(), None).when(c.rlike(_UUID), F.lower(c)).otherwise(F.raise_error(F.lit("invalid UUID")))


def uuid_to_bytes(c: Column) -> Column:
    return F.unhex(F.replace(c, F.lit("-"), F.lit("")))


def uuid_from_bytes(c: Column) -> Column:
    h = F.lower(F.hex(c))
    parts = F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(c.isNull(), None).when(F.octet_length(c) == 16, parts).otherwise(F.raise_error(F.lit("a UUID has 16 bytes")))


# intervals
def interval(months: Column | int, days: Column | int, millis: Column | int) -> Column:
    as_column = lambda x: F.lit(x) if isinstance(x, int) else x
    return F.struct(*(as_column(x).cast("long").alias(n) for x, n in ((months, "months"), (days, "days"), (millis, "millis"))))


def interval_add_to_date(c: Column, i: Column) -> Column:
    """Months first, to the month's end at most, then days; millis don't count."""
    return F.date_add(F.add_months(c, i["months"].cast("int")), i["days"].cast("int"))


def interval_add_to_timestamp(c: Column, i: Column) -> Column:
    return F.timestamp_add("MILLISECOND", i["millis"], F.timestamp_add("DAY", i["days"], F.timestamp_add("MONTH", i["months"], c)))


def interval_order(i: Column) -> Column:
    """Nominal length in milliseconds; a month has 2629746 seconds."""
    return i["months"] * 2_629_746_000 + i["days"] * 86_400_000 + i["millis"]


def interval_format(i: Column) -> Column:
    return F.concat(i["months"].cast("string"), F.lit("mo "), i["days"].cast("string"), F.lit("d "), i["millis"].cast("string"), F.lit("ms"))


# bytes
def bytes_len(c: Column) -> Column:
    return F.octet_length(c)


def bytes_slice(c: Column, start: int, end: int) -> Column:
    """Bytes start to end (exclusive); out of bounds raises."""
    outside = (F.octet_length(c) < end) | F.lit(start > end or start < 0)
    return F.when(outside, F.raise_error(F.lit("slice out of bounds"))).otherwise(F.substring(c, start + 1, end - start))


def bytes_format(c: Column) -> Column:
    return F.lower(F.hex(c))


# nested values
def list_len(c: Column) -> Column:
    return F.size(c)


def list_at(c: Column, i: int) -> Column:
    """0-based; out of range raises."""
    return F.when(c.isNull(), None).when(F.size(c) > i, F.get(c, i)).otherwise(F.raise_error(F.lit("out of range")))


def struct_at(c: Column, kind: T.StructType, i: int) -> Column:
    return c[kind.fields[i].name]


def map_len(c: Column) -> Column:
    return F.size(c)


def map_at(c: Column, i: int) -> Column:
    """The i-th entry, a struct of key and value."""
    return list_at(F.map_entries(c), i)


def kind_of(kind: T.DataType) -> str:
    return {T.ArrayType: "list", T.StructType: "struct", T.MapType: "map"}.get(type(kind), kind.simpleString())


def nested_format(c: Column, kind: T.DataType) -> Column:
    """JSON-like text; structs without field names: {1, "x"}."""
    null = F.lit("null")
    if isinstance(kind, T.ArrayType):
        text = F.concat(F.lit("["), F.array_join(F.transform(c, lambda x: nested_format(x, kind.elementType)), ", "), F.lit("]"))
    elif isinstance(kind, T.StructType):
        text = F.concat(F.lit("{"), F.concat_ws(", ", *(nested_format(c[f.name], f.dataType) for f in kind.fields)), F.lit("}"))
    elif isinstance(kind, T.MapType):
        entry = lambda e: F.concat(nested_format(e["key"], kind.keyType), F.lit(": "), nested_format(e["value"], kind.valueType))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(c), entry), ", "), F.lit("}"))
    elif isinstance(kind, T.BinaryType):
        text = F.concat(F.lit('"'), bytes_format(c), F.lit('"'))
    elif isinstance(kind, T.StringType):
        escaped = c
        for plain, code in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
            escaped = F.replace(escaped, F.lit(plain), F.lit(code))
        text = F.concat(F.lit('"'), escaped, F.lit('"'))
    elif isinstance(kind, (T.NumericType, T.BooleanType)):
        text = c.cast("string")
    else:
        text = F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
    return F.when(c.isNull(), null).otherwise(text)
