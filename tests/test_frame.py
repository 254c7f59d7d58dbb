"""Semantics that SQL doesn't show: nulls, positions, errors, and invariants over generated frames."""

import decimal
import math
import random

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from quarryframe import errors, types
from quarryframe.frame import Frame
from quarryframe.functions import kinds, scalar
from quarryframe.operators import aggregates, cast, joins, nulls, positional, rows, sets
from quarryframe.sources.generate import generate


def frame(spark, data, schema, order=("i",)):
    return Frame(spark.createDataFrame([(i, *r) for i, r in enumerate(data)], f"i long, {schema}"), order)


def cells(f, name):
    return [r[name] for r in f.df.orderBy("i").select(name).collect()]


def test_filter_nulls_and_nan(spark):
    f = frame(spark, [(1.0,), (None,), (math.nan,), (3.0,)], "x double")
    assert f.filter("x", "gt", 0.0).height() == 2
    assert f.filter("x", "neq", 1.0).height() == 2  # NaN and 3
    assert f.filter("x", "neq", math.nan).height() == 3
    assert f.filter("x", "eq", math.nan).height() == 0
    b = frame(spark, [(True,), (False,), (None,)], "b boolean")
    assert b.filter("b", "lt", True).height() == 0
    assert b.filter("b", "eq", True).height() == 1


def test_errors_before_jobs(spark):
    f = frame(spark, [(1, "a")], "x int, s string")
    with pytest.raises(errors.ColumnNotFound):
        f.select("nope")
    with pytest.raises(errors.TypeMismatch):
        f.filter("x", "eq", "1")
    with pytest.raises(errors.TypeNotNumeric):
        f.aggregate("s", "sum")
    with pytest.raises(errors.InvalidQuantile):
        f.aggregate("x", "quantile", 1.5)
    with pytest.raises(errors.UnsafeCast):
        f.cast_safe("x", "i8")
    with pytest.raises(errors.TypeMismatch):
        f.fill_null("x", "zero")
    with pytest.raises(errors.TypeMismatch):
        joins.join(f.df, f.df.withColumn("x", F.col("x").cast("long")), "x")
    with pytest.raises(errors.FrameError):
        Frame(f.df).head(1)
    with pytest.raises(errors.DuplicateColumn):
        f.rename("x", "s")


def test_join_semantics(spark):
    left = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n")], "k int, v string")
    right = spark.createDataFrame([(2, "x"), (3, "y"), (None, "z")], "k int, v string")
    rows_ = {how: sorted((tuple(r) for r in joins.join(left, right, "k", how).collect()), key=str) for how in joins.KINDS}
    assert rows_["inner"] == [(2, "b", "x")]
    assert len(rows_["left"]) == 3
    assert (None, None, "y") in rows_["right"]  # the key of an unmatched right row is null
    assert len(rows_["outer"]) == 5
    assert joins.join(left, right, "k").columns == ["k", "v", "v_right"]
    assert (3, None, "y") in [tuple(r) for r in joins.join(left, right, "k", "outer", coalesce_key=True).collect()]


def test_grouping(spark):
    f = frame(spark, [(1, 10), (2, 20), (1, 30), (2, 40), (1, 50), (None, 99)], "k int, v int")
    got = {r["k"]: r for r in f.group_by("k").agg(s=("v", "sum"), m=("v", "mean"), p=("v", "prod"), first=("v", "first"), last=("v", "last"), sd=("v", "std")).df.collect()}
    assert (got[1]["s"], got[1]["m"], got[1]["p"], got[1]["first"], got[1]["last"]) == (90, 30.0, 15000, 10, 50)
    assert got[2]["sd"] == 10.0 and set(got) == {1, 2}
    nothing = frame(spark, [(1, None), (1, None)], "k int, v int").group_by("k").agg(s=("v", "sum"), m=("v", "mean"), p=("v", "prod"), lo=("v", "min"), n=("v", "nunique")).df.first()
    assert tuple(nothing) == (1, 0, 0.0, 1, None, 0)


def test_overflow_raises(spark):
    f = frame(spark, [(2**31 - 1,), (1,)], "x int")
    with pytest.raises(PySparkException):
        f.aggregate("x", "sum")
    with pytest.raises(PySparkException):
        f.cumulative("x", "sum").df.collect()


def test_positional(spark):
    f = frame(spark, [(1,), (None,), (3,), (2,)], "x int")
    assert cells(f.cumulative("x", "sum"), "x") == [1, None, 4, 6]
    assert cells(f.cumulative("x", "max"), "x") == [1, None, 3, 3]
    assert cells(f.cumulative("x", "min"), "x") == [1, None, 1, 1]
    assert cells(f.cumulative("x", "prod"), "x") == [1, None, 3, 6]
    signs = frame(spark, [(2,), (-3,), (None,), (1,), (0,), (5,)], "x int")
    assert cells(signs.cumulative("x", "prod"), "x") == [2, -6, None, -6, 0, 0]
    assert signs.aggregate("x", "prod") == 0 and signs.drop_row(4).aggregate("x", "prod") == -30
    halves = Frame(signs.df.withColumn("x", (F.col("x") / 2).cast("decimal(9,2)")), ["i"])
    assert cells(halves.cumulative("x", "prod"), "x")[1] == decimal.Decimal("-1.50")
    assert cells(f.shift("x", 1), "x") == [None, 1, None, 3]
    assert cells(f.shift("x", -9), "x") == [None] * 4
    assert cells(f.shift("x", 0), "x") == [1, None, 3, 2]
    assert cells(f.diff("x", 2), "x") == [None, None, 2, None]
    assert cells(f.fill_null_forward("x"), "x") == [1, 1, 3, 2]
    assert cells(f.fill_null_backward("x"), "x") == [1, 3, 3, 2]
    u = frame(spark, [(1,), (0,)], "x long")
    u = Frame(u.df.withColumn("x", F.col("x").alias("x", metadata={"logical": "u32"})), ["i"])
    assert cells(u.diff("x", 1, lossy=True), "x") == [None, None]
    with pytest.raises(PySparkException):
        u.diff("x", 1).df.collect()


@pytest.mark.parametrize("by", [(), ("g",)])
def test_fills_are_linear(spark, by):
    """A range of n rows is one pass in both directions, not n passes over what follows."""
    f = Frame(spark.range(60_000).select(F.col("id").alias("i"), F.lit(1).alias("g"), F.when(F.col("id") % 50_000 == 49_999, F.col("id")).alias("x")), ["i"])
    plan = positional.fill(f.df, "x", ["i"], forward=False, partition_by=by)
    assert "unboundedfollowing" not in plan._jdf.queryExecution().toString().lower().replace("$()", "")
    found = plan.agg(F.count_if(F.col("x") == 49_999), F.count_if(F.col("x").isNull())).first()
    assert tuple(found) == (50_000, 10_000)


def test_sort_and_slices(spark):
    f = frame(spark, [(2,), (None,), (1,)], "x int")
    assert [r["x"] for r in f.sort("x").df.collect()] == [1, 2, None]
    assert [r["x"] for r in f.sort("x", False).df.collect()] == [2, 1, None]
    assert [r["position"] for r in f.arg_sort("x").orderBy("rank").collect()] == [2, 0, 1]
    assert [r["position"] for r in f.arg_sort("x", False).orderBy("rank").collect()] == [0, 2, 1]
    assert [r["x"] for r in f.tail(2).df.collect()] == [None, 1]
    assert f.slice(2, 1).height() == 0 and f.slice(1, 99).height() == 2 and f.head(99).height() == 3
    assert [r["x"] for r in f.take([2, 0, 2]).df.orderBy("_place").collect()] == [1, 2, 1]
    with pytest.raises(errors.IndexOutOfBounds):
        f.take([3])
    assert f.drop_row(0).height() == 2
    words = frame(spark, [("b",), ("a",), (None,), ("ab",)], "x string")
    assert [r["position"] for r in words.arg_sort("x").orderBy("rank").collect()] == [1, 3, 0, 2]


def test_same_needs_no_positions(spark):
    """Frames are compared by one grouping of their rows: no windows, no join."""
    a = spark.createDataFrame([(1, "x", math.nan), (2, None, 0.0), (2, "y", None), (3, "z", 1.0)], "i long, s string, v double")
    assert rows.same(a, a.repartition(3), ["i"])
    assert rows.same(a, a.orderBy(F.desc("s")), ["i"])  # ties of i in any order
    assert not rows.same(a, a.unionAll(a.where("i = 1")), ["i"]) and not rows.same(a.unionAll(a.where("i = 1")), a, ["i"])
    assert not rows.same(a, a.withColumn("v", F.coalesce("v", F.lit(7.0))), ["i"])
    assert not rows.same(a.unionAll(a.where("i = 1")), a.unionAll(a.where("i = 3")), ["i"])
    assert not rows.same(a, a.withColumn("i", F.col("i").cast("int")), ["i"])
    assert rows.same(spark.sql("SELECT 1 AS i, map('a', 1) AS m"), spark.sql("SELECT 1 AS i, map('a', 1) AS m"), ["i"])
    with pytest.raises(errors.ColumnNotFound):
        rows.same(a, a, ["nope"])
    assert rows.same_series(a.where("i != 2"), "v", a.where("i != 2").withColumn("j", F.col("i") + 5), "v", ["i"], ["j"])
    assert not rows.same_series(a.where("i != 2"), "v", a.where("i != 2").withColumn("j", -F.col("i")), "v", ["i"], ["j"])


def test_arg_sort_numbers_rows_once(spark):
    """The second order's ranges are taken from the frame itself, not from its numbered copy: two windows of rows, two exchanges by range."""
    data = [(None if i % 7 == 0 else (i * 37) % 50 + 0.5,) for i in range(500)]
    f = frame(spark, data, "x double")
    for up in (True, False):
        found = f.arg_sort("x", up)
        expected = sorted(range(500), key=lambda i: (data[i][0] is None, (data[i][0] or 0) * (1 if up else -1), i))
        assert [r["position"] for r in found.orderBy("rank").collect()] == expected
        plan = found._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("row_number") == 2


def test_unique_and_concat(spark):
    f = frame(spark, [("a",), (None,), ("a",), (None,), ("b",)], "x string")
    assert sorted(cells(f.unique("x"), "i")) == [0, 1, 4]
    assert f.concat(f).height() == 10
    with pytest.raises(errors.TypeMismatch):
        sets.concat(f.df, f.df.withColumn("x", F.lit(1)))


def test_casts(spark):
    f = frame(spark, [("12",), (" 12 ",), ("x",), ("+7",), (None,), ("1e3",)], "s string")
    assert cells(f.cast_lossy("s", "i32"), "s") == [12, None, None, 7, None, None]
    assert cells(f.cast_lossy("s", "f64"), "s") == [12.0, None, None, 7.0, None, 1000.0]
    with pytest.raises(PySparkException):
        f.cast("s", "i32").df.collect()
    d = frame(spark, [(1.9,), (-1.9,), (3e9,), (math.nan,), (math.inf,), (None,)], "x double")
    assert cells(d.cast_lossy("x", "i32"), "x") == [1, -1, None, None, None, None]
    assert cells(d.cast_lossy("x", "i64"), "x") == [1, -1, 3000000000, None, None, None]
    for bad in (1.5, math.nan, 3e9):
        with pytest.raises(PySparkException):
            frame(spark, [(bad,)], "x double").cast("x", "i32").df.collect()
    texts = frame(spark, [(1.0,), (-0.25,), (1e10,), (1.5e-7,), (123456.789,), (math.nan,), (-math.inf,)], "x double").cast("x", "string")
    assert cells(texts, "x") == ["1", "-0.25", "10000000000", "0.00000015", "123456.789", "nan", "-inf"]
    u = frame(spark, [(-1,), (255,), (256,)], "x int").cast_lossy("x", "u8")
    assert cells(u, "x") == [None, 255, None] and u.type_of("x") == "u8"
    assert cells(frame(spark, [("true",), ("1",), ("yes",)], "s string").cast("s", "bool"), "s") == [True, True, False]


def test_safe_lattice():
    assert types.safe_cast("u32", "i64") and not types.safe_cast("u64", "i64")
    assert types.safe_cast("i32", "f64") and not types.safe_cast("i64", "f64")
    assert types.safe_cast("bool", "u8") and types.safe_cast("f64", "string") and not types.safe_cast("f64", "f32")


def test_scalars(spark):
    low = -(2**31)
    f = frame(spark, [(low,), (5,), (None,), (0,)], "x int")
    assert cells(f.map("x", "negate"), "x") == [low, -5, None, 0]
    assert cells(f.map("x", "abs"), "x") == [low, 5, None, 0]
    assert cells(f.map("x", "signum"), "x") == [-1, 1, None, 0]
    with pytest.raises(PySparkException):
        f.map("x", "square").df.collect()
    d = frame(spark, [(2.5,), (-2.5,), (0.0,), (1e300,)], "x double")
    assert cells(d.map("x", "round"), "x") == [3.0, -3.0, 0.0, 1e300]
    assert cells(d.map("x", "trunc"), "x") == [2.0, -2.0, 0.0, 1e300]
    assert cells(d.map("x", "floor"), "x") == [2.0, -3.0, 0.0, 1e300]
    assert cells(d.map("x", "reciprocal"), "x")[2] == math.inf
    assert cells(Frame(scalar.clip(f.df, "x", -1, 3), ["i"]), "x") == [-1, 3, None, 0]
    assert cells(f.replace("x", (5, 6), (6, 7), (0, 1)), "x") == [low, 6, None, 1]


def test_roundings_are_those_of_sql(spark):
    values = [6896551.724137932, 3389830.5084745763, -1904761.9047619049, 66666666.66666667, 102.4, 1e305]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", scalar.rounded(1 / F.col("v"), 8).alias("r"), scalar.rounded(F.col("v"), 4).alias("x"))
    con = duckdb.connect()
    assert [tuple(r) for r in df.collect()] == [con.execute("SELECT v, round(1 / v, 8), round(v, 4) FROM (SELECT CAST(? AS DOUBLE) AS v)", [v]).fetchone() for v in values]
    odd = spark.createDataFrame([(math.inf,), (None,), (-math.inf,)], "v double").select(scalar.rounded(F.col("v"), 2).alias("r"))
    assert [r["r"] for r in odd.collect()] == [math.inf, None, -math.inf]


def test_nulls_keep_nan(spark):
    f = frame(spark, [(math.nan,), (None,)], "x double")
    assert nulls.drop_nulls(f.df, "x").count() == 1
    assert f.fill_null("x", 0.0).df.where("isnan(x)").count() == 1


def test_kinds(spark):
    one = spark.range(1)
    get = lambda c: one.select(c.alias("x")).first()["x"]
    day = F.lit("2024-01-31").cast("date")
    assert str(get(kinds.interval_add_to_date(day, kinds.interval(1, 1, 0)))) == "2024-03-01"
    assert get(kinds.interval_format(kinds.interval(1, 2, 3))) == "1mo 2d 3ms"
    assert get(kinds.uuid_from_bytes(kinds.uuid_to_bytes(kinds.uuid_parse(F.lit("00112233-4455-6677-8899-AABBCCDDEEFF"))))) == "00112233-4455-6677-8899-aabbccddeeff"
    with pytest.raises(PySparkException):
        get(kinds.uuid_parse(F.lit("zz")))
    a, b = F.lit(decimal.Decimal("-7.00")), F.lit(decimal.Decimal("3.0"))
    assert get(kinds.decimal_div(a, b, 1, 2, 1)) == decimal.Decimal("-2.3")
    with pytest.raises(ValueError):
        kinds.decimal_div(a, b, 0, 2, 1)
    with pytest.raises(PySparkException):
        get(kinds.decimal_rescale(F.lit(decimal.Decimal("1.25")), 10, 1))
    assert get(kinds.bytes_slice(F.lit(b"abcdef"), 1, 3)) == b"bc"
    with pytest.raises(PySparkException):
        get(kinds.bytes_slice(F.lit(b"ab"), 1, 3))
    assert get(kinds.time_format(kinds.time_from(F.lit(3_723_000).cast("long"), "millis"), 3)) == "01:02:03.000"


@pytest.mark.parametrize("null_rate", [0.0, 0.15])
def test_invariants(spark, null_rate):
    df = generate(spark, 3000, seed=7, null_rate=null_rate).withColumn("i", F.monotonically_increasing_id()).cache()
    f, n = Frame(df, ["i"]), 3000
    assert f.height() == n
    missing = f.null_counts()["c_i64"]
    assert f.filter("c_i64", "eq", 5).height() + f.filter("c_i64", "neq", 5).height() + missing == n
    keyed = df.where("c_str is not null")
    counts = aggregates.value_counts(df, "c_str")
    assert counts.agg(F.sum("count")).first()[0] == keyed.count()
    sums = aggregates.grouped(df, "c_str", {"s": ("c_i64", "sum")}).agg(F.sum("s")).first()[0]
    assert sums == keyed.agg(F.sum("c_i64")).first()[0]
    ordered = [r["c_i64"] for r in f.sort("c_i64").df.select("c_i64").collect()]
    present = [x for x in ordered if x is not None]
    assert present == sorted(present) and ordered[len(present):] == [None] * (n - len(present))
    running = [r["c_i64"] for r in f.cumulative("c_i64", "sum").df.orderBy("i").select("c_i64").collect()]
    raw, total, expected = [r["c_i64"] for r in df.orderBy("i").select("c_i64").collect()], 0, []
    for x in raw:
        total += x or 0
        expected.append(None if x is None else total)
    assert running == expected
    assert f.describe().height() == 5
    positions = [r["_pos"] for r in rows.with_position(df, ["i"]).orderBy("i").select("_pos").collect()]
    assert positions == list(range(n))
    assert f.equals(f.shift("c_str", 0))
    assert not f.equals(f.fill_null("c_str", "none")) or null_rate == 0
    before = positional.fill(df, "c_i64", ["i"]).orderBy("i").select("c_i64").collect()
    last, filled = None, []
    for x in raw:
        last = x if x is not None else last
        filled.append(last)
    assert [r["c_i64"] for r in before] == filled
    assert cast.cast(cast.cast(df, "c_i32", "i64"), "c_i32", "i32").agg(F.sum("c_i32")).first() == df.agg(F.sum("c_i32")).first()


def test_print(spark):
    text = frame(spark, [("a", 1.5), (None, 2.0)], "s string, x double").to_string()
    assert "string" in text and "null" in text and "1.5" in text


def test_products_of_any_group_are_exact(spark):
    rng, rows, want = random.Random(3), [], {}
    for g in range(120):
        limit, total = rng.choice([2, 5, 300, 10**6]), 1
        for _ in range(rng.randint(0, 12)):
            x = rng.randint(-limit, limit) if g % 3 else rng.choice([1, -1, 2, -3, 251, 163, 167])
            if abs(total * x) < 2**63:
                total *= x
                rows.append((g, x))
        rows.append((g, None))
        want[g] = total
    rows += [(200, -(2**63)), (200, 1), (201, 2**63 - 1), (202, 0), *[(202, 2**62)] * 9, *[(203, -1)] * 20_001]
    want |= {200: -(2**63), 201: 2**63 - 1, 202: 0, 203: -1}
    f = frame(spark, rows, "k long, v long")
    assert {r["k"]: r["p"] for r in f.group_by("k").agg(p=("v", "prod")).df.collect()} == want
    for beyond in ([2**62, 4], [-(2**63), -1], [10**18] * 3, [3] * 500):
        with pytest.raises(Exception, match="overflow|OVERFLOW"):
            frame(spark, [(0, x) for x in beyond], "k long, v long").aggregate("v", "prod")
