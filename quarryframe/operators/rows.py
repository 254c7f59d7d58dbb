"""Projection, filters, and rows by position.

Rows have positions only through order keys: `order` names columns whose ascending order is the row
order.  Whatever needs a global number of a row gets it without moving all rows to one task
(`with_position`): a sample of all order keys cuts rows into ranges, each range is counted, and the counts'
running sum is added to the place within the range.  The sample is taken when the method is called, all
else when the result is read.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import types
from quarryframe.errors import ColumnNotFound, DuplicateColumn, FrameError, IndexOutOfBounds, TypeMismatch

COMPARISONS: dict[str, Callable[[Column, Column], Column]] = {
    "eq": lambda c, v: c == v,
    "neq": lambda c, v: c != v,
    "lt": lambda c, v: c < v,
    "lte": lambda c, v: c <= v,
    "gt": lambda c, v: c > v,
    "gte": lambda c, v: c >= v,
}

#: Rows that the cuts of one range are sampled from, and the seed of the sample.
SAMPLED, SEED = 32, 5


def checked(df: DataFrame) -> DataFrame:
    """df, unless two columns have one name."""
    seen = set()
    for name in df.columns:
        if name in seen:
            raise DuplicateColumn(name)
        seen.add(name)
    return df


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def ascending(order: Sequence[str]) -> list[Column]:
    return [quoted(c).asc_nulls_last() for c in order]


def descending(order: Sequence[str]) -> list[Column]:
    return [quoted(c).desc_nulls_first() for c in order]


def select(df: DataFrame, names: Sequence[str]) -> DataFrame:
    for n in names:
        types.field_of(df, n)
    return df.select(*(quoted(n) for n in names))


def drop(df: DataFrame, name: str) -> DataFrame:
    """Without the column; no such column: unchanged."""
    return df.drop(name)


def rename(df: DataFrame, old: str, new: str) -> DataFrame:
    """No such column: unchanged."""
    return checked(df.withColumnRenamed(old, new))


def literal(df: DataFrame, name: str, value: object) -> Column:
    """value as the column's type; a value of another kind raises."""
    field = types.field_of(df, name)
    kind = field.dataType
    fits = {
        T.BooleanType: lambda v: isinstance(v, bool),
        T.StringType: lambda v: isinstance(v, str),
        T.BinaryType: lambda v: isinstance(v, (bytes, bytearray)),
        T.FloatType: lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
        T.DoubleType: lambda v: isinstance(v, (int, float)) and not isinstance(v, bool),
    }
    if types.label(field) in {*types.SIGNED, *types.UNSIGNED}:
        low, high = types.bounds(types.label(field))
        if isinstance(value, bool) or not isinstance(value, int) or not low <= value <= high:
            raise TypeMismatch(f"{value!r} is no {types.label(field)}")
    elif type(kind) in fits and not fits[type(kind)](value):
        raise TypeMismatch(f"{value!r} is no {types.label(field)}")
    return F.lit(value).cast(kind)


def condition(df: DataFrame, name: str, op: str, value: object) -> Column:
    """The comparison; null and NaN cells match nothing but NaN's neq; booleans have no order."""
    if op not in COMPARISONS:
        raise FrameError(f"no comparison {op!r}")
    field = types.field_of(df, name)
    c, v = quoted(name), literal(df, name, value)
    if isinstance(field.dataType, T.BooleanType) and op not in ("eq", "neq"):
        return F.lit(False)
    if types.is_float(field):
        if value != value:
            return c.isNotNull() if op == "neq" else F.lit(False)
        if op in ("gt", "gte"):  # Spark ranks NaN above all numbers
            return COMPARISONS[op](c, v) & ~F.isnan(c)
    return COMPARISONS[op](c, v)


def filter_rows(df: DataFrame, name: str, op: str, value: object) -> DataFrame:
    return df.where(condition(df, name, op, value))


def range_key(df: DataFrame, name: str) -> Column | None:
    """A simple value in the column's order; None for types that have none."""
    kind, c = types.field_of(df, name).dataType, quoted(name)
    if isinstance(kind, T.DateType):
        return F.unix_date(c)
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(c)
    if isinstance(kind, T.TimestampNTZType):
        return F.unix_micros(F.to_utc_timestamp(c.cast("timestamp"), F.current_timezone()))
    return c if isinstance(kind, (T.NumericType, T.StringType, T.BinaryType, T.BooleanType)) else None


def range_keys(df: DataFrame, order: Sequence[str]) -> list[Column]:
    """Of the order keys, those up to the first without a range key, each as null flag and value."""
    out: list[Column] = []
    for name in order:
        key = range_key(df, name)
        if key is None:
            break
        out += [key.isNull(), key]
    return out


def with_ranges(df: DataFrame, order: Sequence[str], name: str = "__range", descending_: bool = False) -> DataFrame:
    """df with the number of the range that a row's order keys fall in.

    Ranges follow each other in row order, hold about equally many rows (unless all keys are equal), and
    are as many as shuffle partitions; they are cut by a sample of all keys together, at most SAMPLED rows a
    range, so equal or alike first keys don't make one range.  descending_: the first key falls, nulls last
    still.  A first key of a type without a range key gives one range.
    """
    keys = range_keys(df, order)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if not keys or parts == 1:
        return df.withColumn(name, F.lit(0))
    named = df.select(*(k.alias(f"k{i}") for i, k in enumerate(keys)))
    direction = [F.col("k0"), F.col("k1").desc_nulls_first() if descending_ else F.col("k1").asc(), *(F.col(f"k{i}") for i in range(2, len(keys)))]
    found = named.orderBy(F.rand(SEED)).limit(SAMPLED * parts).orderBy(*direction).collect()
    cuts = list(dict.fromkeys(tuple(found[i * len(found) // parts]) for i in range(1, parts) if found))
    if not cuts:
        return df.withColumn(name, F.lit(0))
    kinds = [f.dataType for f in named.schema]

    def literal_(cut: tuple) -> Column:
        each = [F.lit(bytes(v) if isinstance(v, bytearray) else v).cast(k) for v, k in zip(cut, kinds, strict=True)]
        return F.struct(*(e.alias(f"k{i}") for i, e in enumerate(each)))

    def reached(cut: Column) -> Column:
        """Whether the row stands at the cut or after it; the first key that differs decides, so no struct is made."""
        out = F.lit(True)
        for i in range(len(keys) - 2, -1, -2):
            (flag, value), (cut_flag, cut_value) = keys[i : i + 2], (cut[f"k{i}"], cut[f"k{i + 1}"])
            earlier = cut_value > value if descending_ and i == 0 else cut_value < value
            out = (cut_flag < flag) | ((cut_flag == flag) & (F.coalesce(earlier, F.lit(False)) | (cut_value.eqNullSafe(value) & out)))
        return out

    # two steps of a search: blocks of cuts by their first, then within a block
    width = max(1, round(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    count = lambda array: F.array_size(F.filter(array, reached))
    block = count(F.array(*(literal_(b[0]) for b in blocks)))
    within = count(F.get(F.array(*(F.array(*map(literal_, b)) for b in blocks)), F.col("__block") - 1))
    at = F.when(F.col("__block") == 0, 0).otherwise((F.col("__block") - 1) * width + within)
    return df.withColumn("__block", block).withColumn(name, at.cast("int")).drop("__block")


def dealt_by_range(ranged: DataFrame, name: str = "__range") -> DataFrame:
    """A task for each range."""
    return ranged.repartitionById(int(ranged.sparkSession.conf.get("spark.sql.shuffle.partitions")), F.col(name))


def before_ranges(ranged: DataFrame, value: Column, running: Callable[[Column, WindowSpec], Column], name: str = "__range") -> DataFrame:
    """(__of, __before): for each range what the ranges before it make together; a table of a row a range.

    value aggregates a range's rows; running folds such values, named v, over a window.
    """
    earlier = Window.orderBy("__of").rowsBetween(Window.unboundedPreceding, -1)
    totals = ranged.groupBy(F.col(name).alias("__of")).agg(value.alias("v"))
    return totals.select("__of", running(F.col("v"), earlier).alias("__before"))


def with_position(df: DataFrame, order: Sequence[str], name: str = "_pos", descending_: bool = False) -> DataFrame:
    """df with the 0-based row number by the order keys, without a task that sees all rows.

    descending_: the first key falls, nulls last still.  Ties among all keys are numbered arbitrarily.
    """
    if name in df.columns:
        raise DuplicateColumn(name)
    ranged = with_ranges(df, order, descending_=descending_)
    return _positions(ranged, df, order, name, descending_).drop("__range")


def _positions(ranged: DataFrame, df: DataFrame, order: Sequence[str], name: str, descending_: bool = False, counted: DataFrame | None = None) -> DataFrame:
    """counted: what the ranges are counted from, if not from `ranged`, a cheaper frame with the same rows and __range."""
    offsets = before_ranges(ranged if counted is None else counted, F.count(F.lit(1)), lambda v, w: F.coalesce(F.sum(v).over(w), F.lit(0)))
    first = sort_key(df, order[0])
    keys = [first.desc_nulls_last() if descending_ else first.asc_nulls_last(), *ascending(order[1:])]
    window = Window.partitionBy("__range").orderBy(*keys)
    placed = dealt_by_range(ranged).withColumn("__at", F.row_number().over(window) - 1)
    joined = placed.join(F.broadcast(offsets), F.col("__range") == F.col("__of"))
    return joined.withColumn(name, (F.col("__at") + F.col("__before")).cast("long")).drop("__at", "__of", "__before")


def head(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*ascending(order)).limit(max(n, 0))


def tail(df: DataFrame, n: int, order: Sequence[str]) -> DataFrame:
    return df.orderBy(*descending(order)).limit(max(n, 0)).orderBy(*ascending(order))


def slice_rows(df: DataFrame, start: int, end: int, order: Sequence[str]) -> DataFrame:
    """Rows start to end (exclusive), end clamped; an empty or inverted range has no rows."""
    if end <= start:
        return df.limit(0)
    return with_position(df, order, "__pos").where((F.col("__pos") >= start) & (F.col("__pos") < end)).drop("__pos")


def sort(df: DataFrame, name: str, ascending_: bool = True, ties: Sequence[str] = ()) -> DataFrame:
    """Nulls last in both directions; ties in order of the given keys."""
    types.field_of(df, name)
    key = sort_key(df, name)
    return df.orderBy(key.asc_nulls_last() if ascending_ else key.desc_nulls_last(), *ascending(ties))


def sort_key(df: DataFrame, name: str) -> Column:
    """What a column is ordered by: maps by their entries, intervals by their nominal length."""
    field = types.field_of(df, name)
    c = quoted(name)
    if types.label(field) == "interval":
        return c["months"] * 2_629_746_000 + c["days"] * 86_400_000 + c["millis"]
    return F.map_entries(c) if isinstance(field.dataType, T.MapType) else c


def arg_sort(df: DataFrame, name: str, ascending_: bool, order: Sequence[str]) -> DataFrame:
    """(rank, position): the positions of the rows in sorted order, nulls last."""
    # positions rise with the order keys, so both ranges of a row are known before it has a position
    keys = [f"__o{i}" for i in range(len(order))]
    lean = df.select(quoted(name).alias("key"), *(quoted(o).alias(k) for o, k in zip(order, keys, strict=True)))
    sorted_ = with_ranges(lean, ["key", *keys], "__sorted", descending_=not ascending_)
    numbered = _positions(with_ranges(sorted_, keys), lean, keys, "position").select("key", "position", F.col("__sorted").alias("__range"))
    counted = sorted_.select(F.col("__sorted").alias("__range"))
    return _positions(numbered, numbered, ["key", "position"], "rank", not ascending_, counted).select("rank", "position")


def rows_where(df: DataFrame, name: str, op: str, value: object, order: Sequence[str]) -> DataFrame:
    """(position) of the rows that match."""
    return with_position(df, order, "position").where(condition(df, name, op, value)).select("position")


def take(df: DataFrame, positions: Sequence[int], order: Sequence[str], place: str = "_place") -> DataFrame:
    """The rows at the given positions, in that order and as often; `place` is the place in the list.

    The list is the caller's, so it is small; a position that doesn't exist raises.
    """
    size = df.count()
    if any(not 0 <= p < size for p in positions):
        raise IndexOutOfBounds(f"{size} rows")
    spark = df.sparkSession
    wanted = spark.createDataFrame([(i, p) for i, p in enumerate(positions)], f"`{place}` long, __at long")
    numbered = with_position(df, order, "__pos")
    return numbered.join(F.broadcast(wanted), F.col("__pos") == F.col("__at")).drop("__pos", "__at")


def drop_row(df: DataFrame, position: int, order: Sequence[str]) -> DataFrame:
    if not 0 <= position < df.count():
        raise IndexOutOfBounds(str(position))
    return with_position(df, order, "__pos").where(F.col("__pos") != position).drop("__pos")


def apply(df: DataFrame, name: str, f: Callable[[Column], Column], new: str | None = None) -> DataFrame:
    """f of a column, in place or as a new column; f gets and gives a Column; null cells stay null."""
    types.field_of(df, name)
    c = quoted(name)
    return df.withColumn(new or name, F.when(c.isNotNull(), f(c)))


def apply_python(df: DataFrame, name: str, f: Callable[[object], object], new: str | None = None) -> DataFrame:
    """A Python function from the column's type to itself, over Arrow batches; null cells stay null."""
    kind = types.field_of(df, name).dataType

    @F.pandas_udf(kind)
    def mapped(s: pd.Series) -> pd.Series:
        return s.map(f, na_action="ignore")

    return df.withColumn(new or name, mapped(quoted(name)))


def same_column(df: DataFrame, a: str, b: str) -> bool:
    """Whether two columns are equal row by row; null equals null."""
    return bool(df.agg(F.coalesce(F.bool_and(quoted(a).eqNullSafe(quoted(b))), F.lit(True))).first()[0])


def same_series(a: DataFrame, left: str, b: DataFrame, right: str, order: Sequence[str], other_order: Sequence[str] | None = None) -> bool:
    """Whether a column of a and one of b have one type and equal cells, row by row; null equals null."""
    x = a.select(*(quoted(o).alias(f"o{i}") for i, o in enumerate(order)), quoted(left).alias("cell"))
    y = b.select(*(quoted(o).alias(f"o{i}") for i, o in enumerate(other_order or order)), quoted(right).alias("cell"))
    cells = [with_position(z, [f"o{i}" for i in range(len(z.columns) - 1)], "place").select("place", "cell") for z in (x, y)]
    return same(*cells, ["place"])


def same(a: DataFrame, b: DataFrame, order: Sequence[str]) -> bool:
    """Whether two frames have the same columns, types and rows in order; ties among all order keys may stand in any order."""
    if a.columns != b.columns or [f.dataType for f in a.schema] != [f.dataType for f in b.schema]:
        return False
    missing(a, order)
    # the order keys are columns, so frames of the same rows, each as often, are the same in order
    def plain(df: DataFrame, side: int) -> DataFrame:
        cells = (F.map_entries(quoted(c)) if isinstance(types.field_of(df, c).dataType, T.MapType) else quoted(c) for c in df.columns)
        return df.select(*(c.alias(f"c{i}") for i, c in enumerate(cells)), F.lit(side).alias("side"))

    both = plain(a, 1).unionAll(plain(b, -1))
    return not both.groupBy(*both.columns[:-1]).agg(F.sum("side").alias("more")).where("more != 0").limit(1).count()


def null_counts(df: DataFrame) -> DataFrame:
    """One row: the null cells of every column."""
    return df.agg(*(F.count_if(quoted(c).isNull()).alias(c) for c in df.columns))


def missing(df: DataFrame, names: Sequence[str]) -> None:
    for n in names:
        if n not in df.columns:
            raise ColumnNotFound(n)
