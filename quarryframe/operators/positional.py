"""Operators over the row order: cumulative, shifted and filled columns.

With partition_by they are plain windows.  Without, rows are cut into ranges that follow each other; a
window works within each range, and what the ranges before contribute (a value a range) is added, so
no task sees all rows.  Null cells stay null and pass a running value on.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import types
from quarryframe.errors import FrameError
from quarryframe.operators.aggregates import by_double, factors, narrowed, product
from quarryframe.operators.rows import _positions, ascending, before_ranges, dealt_by_range, descending, quoted, with_ranges


def _exact(c: Column, field: T.StructField) -> Column:
    return c.cast("double") if types.is_float(field) else c.cast("decimal(38,0)") if types.label(field) != "decimal" else c


def cumulative(df: DataFrame, name: str, how: str, order: Sequence[str], partition_by: Sequence[str] = (), new: str | None = None) -> DataFrame:
    """how: sum, min, max or prod.  The column keeps its type; sums and products it can't hold raise."""
    field = types.numeric(df, name)
    c = quoted(name)
    if how not in ("sum", "min", "max", "prod"):
        raise FrameError(f"no cumulative {how!r}")
    ranged = df.withColumn("__range", F.lit(0)) if partition_by else with_ranges(df, order)
    upto = Window.partitionBy("__range", *(quoted(p) for p in partition_by)).orderBy(*ascending(order)).rowsBetween(Window.unboundedPreceding, 0)
    exact = _exact(c, field)
    wide = "double" if by_double(field) else "decimal(38,0)"

    running = {
        "sum": lambda: F.sum(exact).over(upto),
        "min": lambda: F.min(c).over(upto),
        "max": lambda: F.max(c).over(upto),
        "prod": lambda: F.product(c.cast("double")).over(upto) if by_double(field) else _running_product(c, exact, upto),
    }[how]()
    dealt = ranged
    if not partition_by:
        total, fold = {
            "sum": (F.sum(exact), lambda v, w: F.sum(v).over(w)),
            "min": (F.min(c), lambda v, w: F.min(v).over(w)),
            "max": (F.max(c), lambda v, w: F.max(v).over(w)),
            "prod": (product(c, field, exact_only=True), lambda v, w: F.reduce(F.collect_list(v).over(w), F.lit(1).cast(wide), lambda a, x: (a * x).cast(wide))),
        }[how]
        before = before_ranges(ranged, total, fold)
        dealt = dealt_by_range(ranged)
    if how == "prod" and not by_double(field):
        dealt = dealt.withColumn("__zeros", F.count_if(c == 0).over(upto))
    dealt = dealt.withColumn("__running", running)
    value = F.col("__running")
    if not partition_by:
        dealt = dealt.join(F.broadcast(before), F.col("__range") == F.col("__of"))
        carried = F.col("__before")
        value = {
            "sum": lambda: (value + F.coalesce(carried, F.lit(0))).cast(dealt.schema["__running"].dataType),
            "min": lambda: F.least(value, carried),
            "max": lambda: F.greatest(value, carried),
            "prod": lambda: (value * F.coalesce(carried, F.lit(1))).cast(wide),
        }[how]()
    value = F.when(c.isNotNull(), value)
    kept = value.cast(field.dataType) if types.is_float(field) or how in ("min", "max") or types.label(field) == "decimal" else narrowed(value, field)
    return dealt.withColumn(new or name, kept).drop("__range", "__zeros", "__running", "__of", "__before")


def _running_product(c: Column, exact: Column, upto) -> Column:
    """Factors before the first zero, of 2 and more: never more than fit; __zeros counts the zeros so far."""
    size = F.abs(exact)
    big = F.collect_list(F.when((size >= 2) & (F.col("__zeros") == 0), size)).over(upto)
    sign = F.when(F.count_if(c < 0).over(upto) % 2 == 1, F.lit(-1)).otherwise(F.lit(1)).cast("decimal(38,0)")
    return F.when(F.col("__zeros") > 0, F.lit(0)).otherwise((factors(big) * sign).cast("decimal(38,0)"))


def shifted(df: DataFrame, name: str, n: int, order: Sequence[str], partition_by: Sequence[str] = (), new: str = "__shifted") -> DataFrame:
    """df with the cell n rows before (n > 0) or after; null where there is none."""
    c = quoted(name)
    if n == 0:
        return df.withColumn(new, c)
    if partition_by:
        window = Window.partitionBy(*(quoted(p) for p in partition_by)).orderBy(*ascending(order))
        return df.withColumn(new, F.lag(c, n).over(window) if n > 0 else F.lead(c, -n).over(window))
    # within a range a window; only the |n| rows at a range's end meet others, by their number
    ranged = with_ranges(df, order)
    numbered = _positions(ranged, df, order, "__pos")
    rows = Window.partitionBy("__range").orderBy("__pos")
    ends = numbered.select("__range", "__pos", c.alias("__value"))
    counts = ranged.groupBy(F.col("__range").alias("__of")).agg(F.count(F.lit(1)).alias("__size"))
    at = F.row_number().over(rows)
    placed = ends.withColumn("__at", at).join(F.broadcast(counts), F.col("__range") == F.col("__of"))
    giving = placed.where(F.col("__at") > F.col("__size") - n if n > 0 else F.col("__at") <= -n).select((F.col("__pos") + n).alias("__from"), "__value")
    near = numbered.withColumn("__near", F.lag(c, n).over(rows) if n > 0 else F.lead(c, -n).over(rows)).withColumn("__at", at)
    asks = F.col("__at") <= n if n > 0 else F.col("__at") > F.col("__size") + n
    if n < 0:
        near = near.join(F.broadcast(counts), F.col("__range") == F.col("__of"))
    # rows that ask nothing have numbers that none gives, so they don't crowd on one key
    near = near.withColumn("__asked", F.when(asks, F.col("__pos")).otherwise(-1 - F.col("__pos")))
    joined = near.join(giving, F.col("__asked") == F.col("__from"), "left")
    out = joined.withColumn(new, F.when(F.col("__asked") >= 0, F.col("__value")).otherwise(F.col("__near")))
    return out.select(*df.columns, new)


def shift(df: DataFrame, name: str, n: int, order: Sequence[str], partition_by: Sequence[str] = (), new: str | None = None) -> DataFrame:
    types.field_of(df, name)
    return shifted(df, name, n, order, partition_by, "__shifted").withColumn(new or name, F.col("__shifted")).drop("__shifted")


def diff(df: DataFrame, name: str, n: int, order: Sequence[str], partition_by: Sequence[str] = (), lossy: bool = False, new: str | None = None) -> DataFrame:
    """The cell less the one n rows before; out of the type's range raises, or with lossy is null."""
    field = types.numeric(df, name)
    c, before = quoted(name), F.col("__shifted")
    if types.is_float(field) or types.label(field) == "decimal":
        value = (c - before).cast(field.dataType)
    else:
        low, high = types.bounds(types.label(field))
        wide = c.cast("decimal(38,0)") - before.cast("decimal(38,0)")
        outside = F.lit(None) if lossy else F.raise_error(F.lit(f"difference out of range of {types.label(field)}"))
        value = F.when((wide >= low) & (wide <= high), wide).when(wide.isNotNull(), outside).cast(field.dataType)
    return shifted(df, name, n, order, partition_by, "__shifted").withColumn(new or name, value).drop("__shifted")


def fill(df: DataFrame, name: str, order: Sequence[str], forward: bool = True, partition_by: Sequence[str] = (), new: str | None = None) -> DataFrame:
    """Null cells take the last cell before (forward) or the next after that isn't null; if none, they stay."""
    types.field_of(df, name)
    c = quoted(name)
    ranged = df.withColumn("__range", F.lit(0)) if partition_by else with_ranges(df, order)
    # backward is forward in falling order: a frame that ends at the partition's end is folded anew for every row
    ordered = Window.partitionBy("__range", *(quoted(p) for p in partition_by)).orderBy(*(ascending(order) if forward else descending(order)))
    value = F.last(c, ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
    if not partition_by:
        key = F.when(c.isNotNull(), F.struct(*(F.struct(quoted(o).isNull().alias("n"), quoted(o).alias("v")) for o in order)))
        edge = F.max_by(c, key) if forward else F.min_by(c, key)
        # the nearest range before, or after, that has a value
        totals = ranged.groupBy(F.col("__range").alias("__of")).agg(edge.alias("v"))
        near = Window.orderBy(F.col("__of").asc() if forward else F.col("__of").desc()).rowsBetween(Window.unboundedPreceding, -1)
        carried = totals.select("__of", F.last("v", ignorenulls=True).over(near).alias("__carried"))
        ranged = dealt_by_range(ranged).join(F.broadcast(carried), F.col("__range") == F.col("__of"))
        value = F.coalesce(value, F.col("__carried"))
    return ranged.withColumn("__value", F.coalesce(c, value)).withColumn(new or name, F.col("__value")).select(*df.columns, *([new] if new and new not in df.columns else []))
