"""Frame: a fluent, immutable wrapper over a DataFrame and the keys of its row order.

Every method returns a new Frame over a lazy plan, or a value for the few that must run a job.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import types
from quarryframe.errors import FrameError
from quarryframe.functions import scalar
from quarryframe.operators import aggregates, cast, joins, nulls, positional, rows, sets


class Frame:
    def __init__(self, df: DataFrame, order: Sequence[str] = ()):
        self.df, self.order = rows.checked(df), tuple(order)
        rows.missing(df, self.order)

    def _with(self, df: DataFrame) -> Frame:
        return Frame(df, [c for c in self.order if c in df.columns])

    def _ordered(self) -> tuple[str, ...]:
        if not self.order:
            raise FrameError("this needs row order: Frame(df, order=[...])")
        return self.order

    # shape
    def width(self) -> int:
        return len(self.df.columns)

    def height(self) -> int:
        return self.df.count()

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    def type_of(self, name: str) -> str:
        return types.label(types.field_of(self.df, name))

    def column(self, name: str) -> Column | None:
        return self.df[name] if name in self.df.columns else None

    def null_counts(self) -> dict[str, int]:
        return rows.null_counts(self.df).first().asDict()

    def cell(self, name: str, position: int) -> object:
        return self.take([position]).df.select(name).first()[0]

    def copy(self) -> Frame:
        return self  # frames don't change

    # rows and columns
    def select(self, *names: str) -> Frame:
        return self._with(rows.select(self.df, names))

    def drop(self, name: str) -> Frame:
        return self._with(rows.drop(self.df, name))

    def rename(self, old: str, new: str) -> Frame:
        return Frame(rows.rename(self.df, old, new), [new if c == old else c for c in self.order])

    def filter(self, name: str, op: str, value: object) -> Frame:
        return self._with(rows.filter_rows(self.df, name, op, value))

    def positions_where(self, name: str, op: str, value: object) -> DataFrame:
        return rows.rows_where(self.df, name, op, value, self._ordered())

    def take(self, positions: Sequence[int]) -> Frame:
        return Frame(rows.take(self.df, positions, self._ordered()), ["_place"])

    def drop_row(self, position: int) -> Frame:
        return self._with(rows.drop_row(self.df, position, self._ordered()))

    def apply(self, name: str, f: Callable[[Column], Column], new: str | None = None) -> Frame:
        return self._with(rows.apply(self.df, name, f, new))

    def apply_python(self, name: str, f: Callable[[object], object], new: str | None = None) -> Frame:
        return self._with(rows.apply_python(self.df, name, f, new))

    def map(self, name: str, function: str, new: str | None = None) -> Frame:
        return self._with(scalar.mapped(self.df, name, function, new))

    def equals(self, other: Frame) -> bool:
        return rows.same(self.df, other.df, self._ordered())

    # order
    def sort(self, name: str, ascending: bool = True) -> Frame:
        return self._with(rows.sort(self.df, name, ascending, self.order))

    def arg_sort(self, name: str, ascending: bool = True) -> DataFrame:
        return rows.arg_sort(self.df, name, ascending, self._ordered())

    def head(self, n: int = 5) -> Frame:
        return self._with(rows.head(self.df, n, self._ordered()))

    def tail(self, n: int = 5) -> Frame:
        return self._with(rows.tail(self.df, n, self._ordered()))

    def slice(self, start: int, end: int) -> Frame:
        return self._with(rows.slice_rows(self.df, start, end, self._ordered()))

    limit = head

    # joins and sets
    def join(self, other: Frame, on: str, how: str = "inner", coalesce_key: bool = False) -> Frame:
        return self._with(joins.join(self.df, other.df, on, how, coalesce_key))

    def concat(self, other: Frame) -> Frame:
        return self._with(sets.concat(self.df, other.df))

    def unique(self, name: str) -> Frame:
        return self._with(sets.unique(self.df, name, self._ordered()))

    # aggregates
    def aggregate(self, name: str, how: str, q: float = 0.5) -> object:
        return aggregates.whole(self.df, {"value": (name, how)}, q, self.order).first()["value"]

    def group_by(self, *keys: str) -> Grouped:
        for k in keys:
            types.field_of(self.df, k)
        return Grouped(self, keys)

    def value_counts(self, name: str) -> Frame:
        return Frame(aggregates.value_counts(self.df, name))

    def describe(self) -> Frame:
        return Frame(aggregates.describe(self.df))

    # nulls
    def drop_nulls(self, name: str | None = None) -> Frame:
        return self._with(nulls.drop_nulls(self.df, name) if name else nulls.drop_nulls_any(self.df))

    def fill_null(self, name: str, value: object) -> Frame:
        return self._with(nulls.fill_null(self.df, name, value))

    def fill_null_forward(self, name: str, partition_by: Sequence[str] = ()) -> Frame:
        return self._with(positional.fill(self.df, name, self._ordered(), True, partition_by))

    def fill_null_backward(self, name: str, partition_by: Sequence[str] = ()) -> Frame:
        return self._with(positional.fill(self.df, name, self._ordered(), False, partition_by))

    # casts and values
    def cast(self, name: str, target: str) -> Frame:
        return self._with(cast.cast(self.df, name, target))

    def cast_safe(self, name: str, target: str) -> Frame:
        return self._with(cast.cast_safe(self.df, name, target))

    def cast_lossy(self, name: str, target: str) -> Frame:
        return self._with(cast.cast_lossy(self.df, name, target))

    def clip(self, name: str, low: object, high: object) -> Frame:
        return self._with(scalar.clip(self.df, name, low, high))

    def replace(self, name: str, *pairs: tuple[object, object]) -> Frame:
        return self._with(scalar.replace_many(self.df, name, pairs))

    # positional columns
    def cumulative(self, name: str, how: str, partition_by: Sequence[str] = ()) -> Frame:
        return self._with(positional.cumulative(self.df, name, how, self._ordered(), partition_by))

    def shift(self, name: str, n: int, partition_by: Sequence[str] = ()) -> Frame:
        return self._with(positional.shift(self.df, name, n, self._ordered(), partition_by))

    def diff(self, name: str, n: int = 1, lossy: bool = False, partition_by: Sequence[str] = ()) -> Frame:
        return self._with(positional.diff(self.df, name, n, self._ordered(), partition_by, lossy))

    def to_string(self, most: int = 100) -> str:
        """A table of at most `most` rows with names and types, cells to the right."""
        shown = rows.head(self.df, most, self.order) if self.order else self.df.limit(most)
        return table(shown)

    def print(self, most: int = 100) -> None:
        print(self.to_string(most))


class Grouped:
    """Rows by keys; rows with a null key are left out."""

    def __init__(self, frame: Frame, keys: Sequence[str]):
        self.frame, self.keys = frame, keys

    def agg(self, q: float = 0.5, **aggregates_: tuple[str, str]) -> Frame:
        """Several aggregates in one pass: name=(column, aggregate)."""
        return Frame(aggregates.grouped(self.frame.df, self.keys, aggregates_, q, self.frame.order))

    def count(self) -> Frame:
        return self.agg(count=(self.keys[0], "count"))

    def nunique(self, name: str) -> Frame:
        return self.agg(nunique=(name, "nunique"))

    def __getattr__(self, how: str) -> Callable[[str], Frame]:
        if how not in ("sum", "mean", "min", "max", "std", "prod", "first", "last", "median"):
            raise AttributeError(how)
        return lambda name: self.agg(**{name: (name, how)})


def table(df: DataFrame) -> str:
    """df as a bordered table, on the driver."""
    fields = df.schema.fields
    heads = [[f.name for f in fields], [types.label(f) for f in fields]]
    texts = df.select(*(F.coalesce((cast.plain_decimal(rows.quoted(f.name), f) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.lower(F.hex(rows.quoted(f.name))) if isinstance(f.dataType, T.BinaryType) else rows.quoted(f.name).cast("string")), F.lit("null")).alias(f"c{i}") for i, f in enumerate(fields))).collect()
    every = [*heads, *([str(x) for x in r] for r in texts)]
    widths = [max(len(r[i]) for r in every) for i in range(len(fields))]
    edge = "+" + "+".join("-" * (w + 2) for w in widths) + "+"
    line = lambda r: "|" + "|".join(f" {x:>{w}} " for x, w in zip(r, widths, strict=True)) + "|"
    return "\n".join([edge, *map(line, heads), edge, *map(line, every[2:]), edge])
