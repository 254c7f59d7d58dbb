"""Concatenation and first-occurrence distinct rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import types
from quarryframe.errors import TypeMismatch
from quarryframe.operators.rows import ascending, quoted


def concat(first: DataFrame, second: DataFrame) -> DataFrame:
    """All rows of both, by column name; columns only the second has are left out; types must agree."""
    for field in first.schema.fields:
        other = types.field_of(second, field.name)
        if field.dataType != other.dataType or types.label(field) != types.label(other):
            raise TypeMismatch(f"{field.name!r} is {types.label(field)} and {types.label(other)}")
    return first.unionByName(second.select(*(quoted(c) for c in first.columns)))


def unique(df: DataFrame, name: str, order: Sequence[str]) -> DataFrame:
    """The first row of each value of a column, null being a value.

    The order key that comes first is found by an aggregate, which combines before it shuffles, so a hot
    value costs one row a task.  With order keys that aren't unique, one of the tied rows is taken.
    """
    field = types.field_of(df, name)
    value = F.map_entries(quoted(name)) if isinstance(field.dataType, T.MapType) else quoted(name)
    nested = [f.name for f in df.schema.fields if isinstance(f.dataType, T.MapType)]
    if nested:  # min_by can't compare maps in ties of a struct; rows of such frames are ranked
        window = Window.partitionBy(value).orderBy(*ascending(order))
        return df.withColumn("__row", F.row_number().over(window)).where("__row = 1").drop("__row")
    row = F.struct(*(quoted(c) for c in df.columns))
    key = F.struct(*(F.struct(quoted(o).isNull().alias("n"), quoted(o).alias("v")) for o in order))
    return df.groupBy(value.alias("__value")).agg(F.min_by(row, key).alias("__first")).select("__first.*")
