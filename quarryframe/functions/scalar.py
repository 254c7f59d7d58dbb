"""Functions of one Column that keep its type, and value replacement."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import types
from quarryframe.errors import TypeMismatch
from quarryframe.operators.rows import literal, quoted


def identity(c: Column) -> Column:
    return c


def _integer(field: T.StructField) -> bool:
    return types.label(field) in types.SIGNED or types.label(field) in types.UNSIGNED


def negate(c: Column, field: T.StructField) -> Column:
    """The least integer is its own negative."""
    if not _integer(field):
        return -c
    if types.label(field) in types.UNSIGNED:
        raise TypeMismatch("negate needs a signed type")
    low = F.lit(types.bounds(types.label(field))[0]).cast(field.dataType)
    return F.when(c == low, c).otherwise(-F.when(c != low, c)).cast(field.dataType)


def absolute(c: Column, field: T.StructField) -> Column:
    """The least integer stays as it is."""
    if not _integer(field):
        return F.abs(c)
    low = F.lit(types.bounds(types.label(field))[0]).cast(field.dataType)
    return F.when(c == low, c).otherwise(F.abs(F.when(c != low, c))).cast(field.dataType)


def signum(c: Column, field: T.StructField) -> Column:
    return F.when(c > 0, F.lit(1)).when(c < 0, F.lit(-1)).when(c == 0, F.lit(0)).cast(field.dataType) if _integer(field) else F.signum(c).cast(field.dataType)


def square(c: Column, field: T.StructField) -> Column:
    """Out of the type's range raises."""
    return power(c, field, 2)


def cube(c: Column, field: T.StructField) -> Column:
    return power(c, field, 3)


def power(c: Column, field: T.StructField, n: int) -> Column:
    from quarryframe.operators.aggregates import narrowed

    wide = c.cast("decimal(38,0)") if _integer(field) else c
    out = wide
    for _ in range(n - 1):
        out = (out * wide).cast("decimal(38,0)") if _integer(field) else out * wide
    return narrowed(out, field) if _integer(field) else out.cast(field.dataType)


def reciprocal(c: Column, field: T.StructField) -> Column:
    """1/0 is infinite, with the zero's sign."""
    _floats(field)
    negative_zero = F.hex(c.cast("double").cast("string")).startswith("2D")
    infinite = F.when(negative_zero, F.lit(float("-inf"))).otherwise(F.lit(float("inf")))
    return F.when(c == 0, infinite).otherwise(F.lit(1.0) / F.when(c != 0, c)).cast(field.dataType)


def _floats(field: T.StructField) -> None:
    if not types.is_float(field):
        raise TypeMismatch(f"{types.label(field)} is no float")


def _whole(c: Column, field: T.StructField, f) -> Column:
    """f where the value may have a fraction; larger values, NaN and infinities are whole as they are."""
    _floats(field)
    small = F.abs(c) < F.lit(float(1 << 52))
    return F.when(small, f(F.when(small, c)).cast(field.dataType)).otherwise(c)


def floor(c: Column, field: T.StructField) -> Column:
    return _whole(c, field, F.floor)


def ceil(c: Column, field: T.StructField) -> Column:
    return _whole(c, field, F.ceil)


def round_(c: Column, field: T.StructField) -> Column:
    """Halves away from zero."""
    return _whole(c, field, lambda x: F.signum(x) * (F.floor(F.abs(x)) + (F.abs(x) - F.floor(F.abs(x)) >= 0.5).cast("int")))


def trunc(c: Column, field: T.StructField) -> Column:
    return _whole(c, field, lambda x: F.when(x >= 0, F.floor(x)).otherwise(F.ceil(x)))


def rounded(c: Column, places: int) -> Column:
    """A double to so many places by the product with a power of ten, halves away from zero, as SQL's round does.

    F.round goes by a double's shortest decimal text instead, which differs where the product is a half.
    """
    scale = F.lit(10.0**places)
    found = F.round(c * scale) / scale
    return F.when(F.abs(found) < float("inf"), found).otherwise(c)


FUNCTIONS = {"negate": negate, "abs": absolute, "signum": signum, "square": square, "cube": cube, "reciprocal": reciprocal, "floor": floor, "ceil": ceil, "round": round_, "trunc": trunc}


def mapped(df: DataFrame, name: str, function: str, new: str | None = None) -> DataFrame:
    """df with a function of FUNCTIONS (or identity) applied to a column, in place or as a new one."""
    field = types.field_of(df, name) if function == "identity" else types.numeric(df, name)
    c = quoted(name)
    return df.withColumn(new or name, identity(c) if function == "identity" else FUNCTIONS[function](c, field))


def clip(df: DataFrame, name: str, low: object, high: object) -> DataFrame:
    types.numeric(df, name)
    c = quoted(name)
    return df.withColumn(name, F.when(c.isNotNull(), F.greatest(literal(df, name, low), F.least(literal(df, name, high), c))))


def replace(df: DataFrame, name: str, old: object, new: object) -> DataFrame:
    return replace_many(df, name, [(old, new)])


def replace_many(df: DataFrame, name: str, pairs: Sequence[tuple[object, object]]) -> DataFrame:
    """The first pair whose old value equals the cell gives the new one; nulls match none."""
    c, out = quoted(name), None
    for old, new in pairs:
        hit = c == literal(df, name, old)
        value = literal(df, name, new)
        out = F.when(hit, value) if out is None else out.when(hit, value)
    return df if out is None else df.withColumn(name, out.otherwise(c))
