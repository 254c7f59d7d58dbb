"""Aggregates of whole columns and of groups; null cells are skipped.

Sums keep the column's type and raise where it can't hold them; sums, means and deviations of nothing
are 0, products 1, all others null.  Deviations are of the population.  first and last are the first and
last cells that aren't null, by the order keys.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import types
from quarryframe.errors import FrameError, InvalidQuantile
from quarryframe.operators.rows import quoted

ORDERED = {"first", "last"}
ANY_TYPE = {"first", "last", "nunique", "null_count", "count"}

#: The 17 primes below 256 from the largest on; their product is 1.8e39, its logarithm 90.4, that of 10^38 is 87.5.
PRIMES = [p for p in range(255, 162, -1) if all(p % d for d in range(2, 16))]
MOST_LOG = 89.0


def narrowed(c: Column, field: T.StructField) -> Column:
    """c as the column's type; integers out of its logical range raise."""
    name = types.label(field)
    if name in types.UNSIGNED or name in types.SIGNED:
        low, high = types.bounds(name)
        c = F.when((c < low) | (c > high), F.raise_error(F.lit(f"overflow of {name}"))).otherwise(c)
    return c.cast(field.dataType)


def product(c: Column, field: T.StructField, exact_only: bool = False) -> Column:
    """The product, exact for integers, as the column's type; exact_only: as decimal(38,0), in any range."""
    if by_double(field):
        return F.coalesce(F.product(c.cast("double")), F.lit(1.0)).cast("double" if exact_only else field.dataType)
    # sums alone, so that groups of any size combine before they are shuffled: see _residue
    size = F.coalesce(F.sum(F.when(c != 0, F.ln(F.abs(c.cast("double"))))), F.lit(0.0))
    sign = F.when(F.count_if(c < 0) % 2 == 1, F.lit(-1)).otherwise(F.lit(1))
    # of the product's size
    residues = (F.pmod(_residue(c, p) * sign, F.lit(p)) for p in PRIMES)
    total = _from_residues(F.array(*(F.struct(F.lit(i).alias("i"), r.alias("r")) for i, r in enumerate(residues)))) * sign
    overflow = F.raise_error(F.lit(f"overflow of a product of {types.label(field)}")).cast("decimal(38,0)")
    exact = F.when(F.count_if(c == 0) > 0, F.lit(0)).when(size > MOST_LOG, overflow).otherwise(total.cast("decimal(38,0)"))
    return exact if exact_only else narrowed(exact, field)


def _table(values: Sequence[int] | Sequence[Sequence[int]]) -> Column:
    return F.expr("array(" + ", ".join(str(v) if isinstance(v, int) else f"array({', '.join(map(str, v))})" for v in values) + ")")


def _powers(p: int) -> list[int]:
    """The powers of p's least primitive root: all of 1 to p - 1, once each."""
    for g in range(2, p):
        out = [1]
        while (following := out[-1] * g % p) != 1:
            out.append(following)
        if len(out) == p - 1:
            return out
    raise AssertionError(p)


def _residue(c: Column, p: int) -> Column:
    """The product modulo the prime p: factors that p doesn't divide are powers of one root, whose exponents add up."""
    powers = _powers(p)
    exponents = sorted(range(p - 1), key=powers.__getitem__)  # of 1, 2, ...
    rest = F.pmod(c, F.lit(p)).cast("int")
    total = F.coalesce(F.sum(F.get(_table([0, *exponents]), rest)), F.lit(0))
    return F.when(F.coalesce(F.bool_or(rest == 0), F.lit(False)), 0).otherwise(F.get(_table(powers), (total % (p - 1)).cast("int")))


def _from_residues(residues: Column) -> Column:
    """The decimal(38,0) below the product of PRIMES with these residues, an array of structs (i, r)."""
    inverse = _table([[pow(q, -1, p) if p != q else 0 for q in PRIMES] for p in PRIMES])
    primes = _table(PRIMES)

    def digit(digits: Column, x: Column) -> Column:
        """One more digit of the number in the mixed radix of PRIMES, least first."""
        p = F.get(primes, x["i"])
        left = F.reduce(
            F.transform(digits, lambda d, j: F.struct(d.alias("d"), j.alias("j"))),
            x["r"],
            lambda t, y: F.pmod((t - y["d"]) * F.get(F.get(inverse, x["i"]), y["j"]), p),
        )
        return F.concat(digits, F.array(left))

    placed = F.transform(F.reduce(residues, F.expr("cast(array() as array<int>)"), digit), lambda d, j: F.struct(d.alias("d"), F.get(primes, j).alias("p")))
    wide = "decimal(38,0)"
    return F.reduce(F.reverse(placed), F.lit(0).cast(wide), lambda v, x: (v * x["p"].cast(wide) + x["d"].cast(wide)).cast(wide))


def by_double(field: T.StructField) -> bool:
    """Whether products go through doubles: floats, and decimals with fractions."""
    return types.is_float(field) or types.label(field) == "decimal"


def factors(values: Column) -> Column:
    """The product of an array of decimals; beyond 38 digits raises."""
    return F.reduce(values, F.lit(1).cast("decimal(38,0)"), lambda a, x: (a * x).cast("decimal(38,0)"))


def aggregate(df: DataFrame, name: str, how: str, q: float = 0.5, order: Sequence[str] = ()) -> Column:
    """The aggregate as a Column without an alias."""
    if how == "count":
        return F.count(F.lit(1))
    field = types.field_of(df, name) if how in ANY_TYPE else types.numeric(df, name)
    c = quoted(name)
    if how == "null_count":
        return F.count_if(c.isNull())
    if how in ("sum", "sum_checked"):
        wide = c.cast("decimal(38,0)") if types.label(field) in ("i64", "u64", "usize", "isize") else c
        total = F.coalesce(F.sum(wide), F.lit(0))
        return total.cast(field.dataType) if types.is_float(field) or isinstance(field.dataType, T.DecimalType) and types.label(field) == "decimal" else narrowed(total, field)
    if how == "mean":
        return F.coalesce(F.avg(c).cast("double"), F.lit(0.0))
    if how == "std":
        return F.coalesce(F.stddev_pop(c), F.lit(0.0))
    if how in ("min", "max"):
        return F.min(c) if how == "min" else F.max(c)
    if how in ("prod", "prod_checked"):
        return product(c, field)
    if how in ORDERED:
        if not order:
            raise FrameError(f"{how} needs order keys")
        key = F.struct(*(quoted(o) for o in order))
        present = F.when(c.isNotNull(), key)  # rows with a null key part of max_by are passed over
        return F.min_by(c, present) if how == "first" else F.max_by(c, present)
    if how == "median":
        return F.median(c)
    if how == "quantile":
        if not 0 <= q <= 1:
            raise InvalidQuantile(str(q))
        return F.percentile(c, q)
    if how == "nunique":
        return F.count_distinct(c)
    raise FrameError(f"no aggregate {how!r}")


def whole(df: DataFrame, aggregates: dict[str, tuple[str, str]], q: float = 0.5, order: Sequence[str] = ()) -> DataFrame:
    """One row of {result name: (column, aggregate)}, in one pass."""
    return df.agg(*(aggregate(df, c, how, q, order).alias(n) for n, (c, how) in aggregates.items()))


def grouped(df: DataFrame, keys: str | Sequence[str], aggregates: dict[str, tuple[str, str]], q: float = 0.5, order: Sequence[str] = ()) -> DataFrame:
    """A row for each group of {result name: (column, aggregate)}; rows with a null key are left out."""
    names = [keys] if isinstance(keys, str) else list(keys)
    for n in names:
        types.field_of(df, n)
    present = df.where(_all_present(names))
    return present.groupBy(*(quoted(n) for n in names)).agg(*(aggregate(df, c, how, q, order).alias(n) for n, (c, how) in aggregates.items()))


def _all_present(names: Sequence[str]) -> Column:
    out = F.lit(True)
    for n in names:
        out &= quoted(n).isNotNull()
    return out


def group_key(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """df with _group_key, the keys joined by `|`, for callers that want one key; ambiguous if keys hold `|`."""
    return df.where(_all_present(names)).withColumn("_group_key", F.concat_ws("|", *(quoted(n).cast("string") for n in names)))


def value_counts(df: DataFrame, name: str) -> DataFrame:
    return grouped(df, name, {"count": (name, "count")})


def describe(df: DataFrame) -> DataFrame:
    """Rows count, mean, std, min and max; a double column for each numeric column; one pass over df."""
    stats = ("count", "mean", "std", "min", "max")
    names = [f.name for f in df.schema.fields if types.label(f) in types.NUMERIC or types.label(f) == "decimal"]
    one = df.agg(*(
        (F.count(quoted(n)) if s == "count" else aggregate(df, n, s)).cast("double").alias(f"{s}_{i}")
        for i, n in enumerate(names) for s in stats
    )) if names else df.sparkSession.range(1)
    rows = F.array(*(F.struct(F.lit(s).alias("stat"), *(F.col(f"{s}_{i}").alias(n) for i, n in enumerate(names))) for s in stats))
    return one.select(F.inline(rows))
