"""Equi-joins on one key of one name.

Null keys match nothing.  A right column whose name the left has gets the suffix `_right`, again until it
is free.  Unmatched right rows of right and outer joins have a null key, unless coalesce_key.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import types
from quarryframe.errors import FrameError, TypeMismatch
from quarryframe.operators.rows import quoted

KINDS = {"inner": "inner", "left": "left", "right": "right", "outer": "full"}


def _key(df: DataFrame, name: str) -> Column:
    c = quoted(name)
    return F.map_entries(c) if isinstance(types.field_of(df, name).dataType, T.MapType) else c


def join(left: DataFrame, right: DataFrame, on: str, how: str = "inner", coalesce_key: bool = False, order: tuple[str, str] | None = None) -> DataFrame:
    """order: the names of the left's and the right's row order keys, to sort the result by them."""
    if how not in KINDS:
        raise FrameError(f"no join {how!r}")
    a, b = types.field_of(left, on), types.field_of(right, on)
    if a.dataType != b.dataType or types.label(a) != types.label(b):
        raise TypeMismatch(f"{on!r} is {types.label(a)} and {types.label(b)}")
    taken, renamed = set(left.columns), {}
    for c in right.columns:
        if c == on:
            continue
        name = c
        while name in taken:
            name += "_right"
        taken.add(name)
        renamed[c] = name
    key_name = "__key"
    while key_name in taken:
        key_name += "_"
    other = right.select(_key(right, on).alias(key_name), quoted(on).alias(key_name + "_"), *(quoted(c).alias(n) for c, n in renamed.items()))
    joined = left.join(other, _key(left, on) == F.col(key_name), KINDS[how])
    key = F.coalesce(quoted(on), F.col(key_name + "_")) if coalesce_key else quoted(on)
    if order:
        l, r = quoted(order[0]), quoted(renamed.get(order[1], order[1]))
        joined = joined.orderBy(l.asc_nulls_last(), r.asc_nulls_last())
    return joined.select(*(key.alias(c) if c == on else quoted(c) for c in left.columns), *(quoted(n) for n in renamed.values()))


def join_salted(left: DataFrame, right: DataFrame, on: str, how: str = "inner", salts: int = 16) -> DataFrame:
    """An inner or left join whose right rows are copied once a salt, for left keys too hot for one task.

    For rights of few rows a key; adaptive execution splits hot keys of `join` by itself where it can.
    """
    if how not in ("inner", "left"):
        raise FrameError("only inner and left joins keep their rows when salted")
    salt = F.pmod(F.xxhash64(*(quoted(c) for c in left.columns if not isinstance(types.field_of(left, c).dataType, T.MapType))), F.lit(salts)).cast("int")
    copies = right.withColumn("__salt_right", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    names: Sequence[str] = [c for c in right.columns if c != on]
    clash = [n for n in names if n in left.columns]
    for n in clash:
        copies = copies.withColumnRenamed(n, n + "_right")
    copies = copies.withColumnRenamed(on, "__key")
    salted = left.withColumn("__salt", salt)
    joined = salted.join(copies, (F.col(on) == F.col("__key")) & (F.col("__salt") == F.col("__salt_right")), KINDS[how])
    return joined.drop("__salt", "__salt_right", "__key")
