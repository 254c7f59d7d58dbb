"""Dropping and filling null cells.  NaN is no null."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe import types
from quarryframe.operators.rows import literal, quoted


def drop_nulls(df: DataFrame, name: str) -> DataFrame:
    types.field_of(df, name)
    return df.where(quoted(name).isNotNull())


def drop_nulls_any(df: DataFrame) -> DataFrame:
    keep = F.lit(True)
    for c in df.columns:
        keep &= quoted(c).isNotNull()
    return df.where(keep)


def fill_null(df: DataFrame, name: str, value: object) -> DataFrame:
    """value must be of the column's type."""
    return df.withColumn(name, F.coalesce(quoted(name), literal(df, name, value)))
