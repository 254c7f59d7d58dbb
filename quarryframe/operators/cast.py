"""Casts in three tiers: safe (checked when planned), strict (raises at a bad cell), lossy (null there)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import types
from quarryframe.errors import TypeNotCastable, UnsafeCast
from quarryframe.operators.rows import quoted

_INTEGER = r"^[+-]?[0-9]+$"
_DECIMAL = r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
_SPECIAL = r"(?i)^[+-]?(nan|inf|infinity)$"


def plain_decimal(c: Column, field: T.StructField) -> Column:
    """A float in plain notation without exponent or trailing zeros: 1, -0.25, 10000000000; nan, inf, -inf."""
    digits = c.cast("string")
    mantissa = F.regexp_extract(digits, r"^-?([0-9]+)\.?([0-9]*)", 1)
    fraction = F.regexp_replace(F.regexp_extract(digits, r"^-?[0-9]+\.([0-9]*)", 1), "^0$", "")
    power = F.coalesce(F.try_to_number(F.regexp_extract(digits, r"E([0-9]+)$", 1), F.lit("999")).cast("int"), -F.try_to_number(F.regexp_extract(digits, r"E-([0-9]+)$", 1), F.lit("999")).cast("int"), F.lit(0))
    every = F.concat(mantissa, fraction)
    point = F.length(mantissa) + power
    whole = F.when(point <= 0, F.lit("0")).otherwise(F.rpad(F.substring(every, F.lit(1), point), point, "0"))
    rest = F.when(point <= 0, F.concat(F.repeat(F.lit("0"), -point), every)).otherwise(F.substring(every, point + 1, F.length(every)))
    rest = F.regexp_replace(rest, "0+$", "")
    text = F.concat(F.when(digits.startswith("-"), "-").otherwise(""), whole, F.when(rest != "", F.concat(F.lit("."), rest)).otherwise(""))
    return F.when(F.isnan(c), "nan").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(text)


def _fail(message: str) -> Column:
    return F.raise_error(F.lit(message))


def _to_integer(c: Column, source: str, target: str, strict: bool) -> Column:
    low, high = types.bounds(target)
    kind = types.stored(target)
    bad = (lambda m: _fail(m)) if strict else (lambda m: F.lit(None))
    if source == "bool":
        return c.cast("int").cast(kind)
    if source == "string":
        number = F.when(c.rlike(_INTEGER), c.try_cast("decimal(38,0)"))
        return F.when(c.isNull(), None).when((number >= low) & (number <= high), number).otherwise(bad("not an integer in range")).cast(kind)
    if source in types.FLOATS:
        exact = c.cast("double")
        # the bounds as doubles: the upper one is the next power of two, which is out
        inside = (exact > float(low) - 1) & (exact < float(high) + 1) if abs(low) < 1 << 52 else (exact >= float(low)) & (exact < float(high + 1))
        whole = (exact - exact % 1).try_cast("decimal(38,0)")
        truncated = F.when(inside, exact.try_cast("bigint") if high < 1 << 63 else whole)
        if not strict:
            return F.when(F.isnan(exact), None).otherwise(truncated).cast(kind)
        return (
            F.when(c.isNull(), None)
            .when(F.isnan(exact) | (F.abs(exact) == float("inf")), _fail("invalid cast: not a finite number"))
            .when(~inside, _fail("overflow"))
            .when(truncated.cast("double") != exact, _fail("lossy cast: not whole"))
            .otherwise(truncated)
            .cast(kind)
        )
    return F.when(c.isNull(), None).when((c >= low) & (c <= high), c).otherwise(bad("overflow")).cast(kind)


def cast_column(df: DataFrame, name: str, target: str, strict: bool = True) -> Column:
    field = types.field_of(df, name)
    source, c = types.label(field), quoted(name)
    if source not in types.CASTABLE or target not in types.CASTABLE:
        raise TypeNotCastable(f"{source} to {target}")
    if source == target:
        return c
    if target == "string":
        return plain_decimal(c, field) if source in types.FLOATS else c.cast("string")
    if target == "bool":
        if source == "string":
            return c.isin("true", "1")
        return c != F.lit(0).cast(field.dataType)
    if target in types.FLOATS:
        if source == "string":
            special = F.when(F.lower(c).rlike("nan"), F.lit(float("nan"))).when(c.startswith("-"), F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
            value = F.when(c.rlike(_DECIMAL), c.try_cast("double")).when(c.rlike(_SPECIAL), special)
            if strict:
                value = F.when(c.isNull(), None).otherwise(F.coalesce(value, _fail("not a number")))
            return value.cast(types.stored(target))
        return c.cast("int").cast(types.stored(target)) if source == "bool" else c.cast(types.stored(target))
    return _to_integer(c, source, target, strict)


def cast(df: DataFrame, name: str, target: str) -> DataFrame:
    """Strict: overflow, lost fractions and unreadable strings raise when the job reaches them."""
    return df.withColumn(name, cast_column(df, name, target).alias(name, metadata=types.metadata(target)))


def cast_lossy(df: DataFrame, name: str, target: str) -> DataFrame:
    """Cells that don't fit become null; floats are cut toward zero."""
    return df.withColumn(name, cast_column(df, name, target, strict=False).alias(name, metadata=types.metadata(target)))


def cast_safe(df: DataFrame, name: str, target: str) -> DataFrame:
    """Only casts that hold every value; others raise before any job."""
    source = types.label(types.field_of(df, name))
    if not types.safe_cast(source, target):
        raise UnsafeCast(f"{source} to {target}")
    return cast(df, name, target)
