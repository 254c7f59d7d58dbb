"""The operators as queries over the driver's tables, each with SQL of the same meaning.

Tables without nulls get them by rule: every seventh customer's price is null, error events have no type,
signup events no value.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.errors import FrameError
from quarryframe.functions import kinds, scalar
from quarryframe.operators import aggregates, cast, joins, nulls, positional, rows, sets
from quarryframe.sources import csv, generate, json, parquet, tdf

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders").withColumn("nv", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")))


def events(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    return e.select("event_id", "user_id", F.nullif("event_type", F.lit("error")).alias("k"), F.when(F.col("event_type") != "signup", F.col("value")).alias("v"), F.when(F.col("event_id") % 5 != 0, F.col("user_id") % 100).alias("n"))


ORDERS = "(SELECT *, CASE WHEN o_custkey % 7 <> 0 THEN o_totalprice END AS nv FROM orders)"
EVENTS = "(SELECT event_id, user_id, nullif(event_type, 'error') AS k, CASE WHEN event_type <> 'signup' THEN value END AS v, CASE WHEN event_id % 5 <> 0 THEN user_id % 100 END AS n FROM events)"

# projection and filters


@query("flagship", "SELECT l_returnflag, round(sum(l_extendedprice), 2) AS sum_price, count(*) AS n FROM lineitem WHERE l_quantity > 25 GROUP BY l_returnflag")
def _(spark, sf):
    items = rows.filter_rows(table(spark, sf, "lineitem"), "l_quantity", "gt", 25.0)
    return aggregates.grouped(items, "l_returnflag", {"sum_price": ("l_extendedprice", "sum"), "n": ("l_returnflag", "count")}).withColumn("sum_price", scalar.rounded(F.col("sum_price"), 2))


@query("select", "SELECT c_name, c_custkey FROM customer")
def _(spark, sf):
    return rows.select(table(spark, sf, "customer"), ["c_name", "c_custkey"])


@query("rename", "SELECT c_custkey AS id, c_name FROM customer")
def _(spark, sf):
    return rows.rename(rows.select(table(spark, sf, "customer"), ["c_custkey", "c_name"]), "c_custkey", "id")


@query("drop", "SELECT n_nationkey, n_name FROM nation")
def _(spark, sf):
    return rows.drop(rows.drop(table(spark, sf, "nation"), "n_regionkey"), "missing")


for _op, _sign in {"eq": "=", "neq": "<>", "lt": "<", "lte": "<=", "gt": ">", "gte": ">="}.items():

    # a value that about one row in a hundred has, so that each comparison has its own result
    @query(f"filter_{_op}", f"SELECT event_id, n FROM {EVENTS} WHERE n {_sign} 50")
    def _(spark, sf, op=_op):
        return rows.filter_rows(events(spark, sf), "n", op, 50).select("event_id", "n")


@query("filter_chain", "SELECT o_orderkey FROM orders WHERE o_totalprice > 1000 AND o_orderstatus = 'O' AND o_totalprice <= 100000")
def _(spark, sf):
    df = rows.filter_rows(table(spark, sf, "orders"), "o_totalprice", "gt", 1000.0)
    return rows.filter_rows(rows.filter_rows(df, "o_orderstatus", "eq", "O"), "o_totalprice", "lte", 100000.0).select("o_orderkey")


@query("filter_by_indices", "SELECT i.place AS _place, o_orderkey, o_custkey FROM (VALUES (0, 3), (1, 1), (2, 3), (3, 124)) i(place, spot) JOIN (SELECT *, row_number() OVER (ORDER BY o_orderkey) - 1 AS r FROM orders) ON r = i.spot")
def _(spark, sf):
    return rows.take(table(spark, sf, "orders"), [3, 1, 3, 124], ["o_orderkey"]).select(F.col("_place").cast("int").alias("_place"), "o_orderkey", "o_custkey")


@query("indices_where", "SELECT CAST(p AS BIGINT) AS position FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS p, o_totalprice FROM orders) WHERE o_totalprice > 100000")
def _(spark, sf):
    return rows.rows_where(table(spark, sf, "orders"), "o_totalprice", "gt", 100000.0, ["o_orderkey"])


@query("drop_row", "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) WHERE r <> 8")
def _(spark, sf):
    return rows.drop_row(table(spark, sf, "orders"), 7, ["o_orderkey"]).select("o_orderkey", "o_custkey")


@query("apply_column", "SELECT event_id, v * 2 + 1 AS v FROM " + EVENTS)
def _(spark, sf):
    return rows.apply(events(spark, sf), "v", lambda c: c * 2 + 1).select("event_id", "v")


@query("apply_python", "SELECT event_id, n, n * 3 AS thrice FROM " + EVENTS)
def _(spark, sf):
    return rows.apply_python(events(spark, sf), "n", lambda x: x * 3, "thrice").select("event_id", "n", "thrice")


@query("null_counts", f"SELECT CAST(count(*) - count(k) AS BIGINT) AS k, CAST(count(*) - count(v) AS BIGINT) AS v FROM {EVENTS}")
def _(spark, sf):
    return rows.null_counts(events(spark, sf).select("k", "v"))


# joins

# all rows of both tables; keys without a partner come from computed columns
_SIDES = "(SELECT CASE WHEN c_custkey % 5 = 0 THEN -c_custkey ELSE c_custkey END AS k, c_name FROM customer) l {} JOIN (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -5 * o_custkey - 1 ELSE o_custkey END AS k, o_orderkey FROM orders) r ON l.k = r.k"


def _sides(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    left = table(spark, sf, "customer").select(F.when(F.col("c_custkey") % 5 == 0, -F.col("c_custkey")).otherwise(F.col("c_custkey")).alias("k"), "c_name")
    right = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 7 == 0, -5 * F.col("o_custkey") - 1).otherwise(F.col("o_custkey")).alias("k"), "o_orderkey")
    return left, right


for _how, _sql in {"inner": "INNER", "left": "LEFT", "right": "RIGHT", "outer": "FULL"}.items():

    @query(f"join_{_how}", f"SELECT l.k AS k, c_name, o_orderkey FROM {_SIDES.format(_sql)}")
    def _(spark, sf, how=_how):
        return joins.join(*_sides(spark, sf), "k", how)


@query("join_outer_coalesced", f"SELECT coalesce(l.k, r.k) AS k, c_name, o_orderkey FROM {_SIDES.format('FULL')}")
def _(spark, sf):
    return joins.join(*_sides(spark, sf), "k", "outer", coalesce_key=True)


@query("join_suffix", "SELECT n_nationkey AS k, n_name AS name, s_name AS name_right FROM nation JOIN supplier ON n_nationkey = s_nationkey")
def _(spark, sf):
    left = table(spark, sf, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("name"))
    right = table(spark, sf, "supplier").select(F.col("s_nationkey").alias("k"), F.col("s_name").alias("name"))
    return joins.join(left, right, "k")


@query("join_null_key", f"SELECT e.event_id, e.k, c.n FROM {EVENTS} e LEFT JOIN (SELECT k, count(*) AS n FROM {EVENTS} GROUP BY k) c ON e.k = c.k")
def _(spark, sf):
    e = events(spark, sf)
    return joins.join(e.select("event_id", "k"), e.groupBy("k").agg(F.count(F.lit(1)).alias("n")), "k", "left")


@query("join_salted", "SELECT l_orderkey, l_linenumber, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def _(spark, sf):
    left = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("k"), "l_linenumber", "l_shipdate", "l_partkey")
    right = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey")
    return joins.join_salted(left, right, "k", salts=4).select(F.col("k").alias("l_orderkey"), "l_linenumber", "o_custkey")


# aggregates

_WHOLE = {
    "sum": "round(coalesce(sum(nv), 0), 2)",
    "mean": "round(coalesce(avg(nv), 0), 4)",
    "std": "round(coalesce(stddev_pop(nv), 0), 4)",
    "min": "min(nv)",
    "max": "max(nv)",
    "median": "round(median(nv), 4)",
    "nunique": "count(DISTINCT nv)",
    "null_count": "count(*) - count(nv)",
    "first": "arg_min(nv, o_orderkey) FILTER (WHERE nv IS NOT NULL)",
    "last": "arg_max(nv, o_orderkey) FILTER (WHERE nv IS NOT NULL)",
}
_PLACES = {"sum": 2, "mean": 4, "std": 4, "median": 4}


def _rounded(c: str, how: str):
    return scalar.rounded(F.col(c), _PLACES[how]).alias(c) if how in _PLACES else F.col(c)


@query("agg_whole", f"SELECT {', '.join(f'{e} AS {n}' for n, e in _WHOLE.items())} FROM {ORDERS}")
def _(spark, sf):
    one = aggregates.whole(orders(spark, sf), {h: ("nv", h) for h in _WHOLE}, order=["o_orderkey"])
    return one.select(*(_rounded(h, h) for h in _WHOLE))


@query("agg_quantile", f"SELECT round(quantile_cont(nv, 0.25), 4) AS q25, round(quantile_cont(nv, 0.9), 4) AS q90 FROM {ORDERS}")
def _(spark, sf):
    df = orders(spark, sf)
    return df.agg(*(scalar.rounded(aggregates.aggregate(df, "nv", "quantile", q), 4).alias(n) for n, q in (("q25", 0.25), ("q90", 0.9))))


_SIGNS = "CASE WHEN o_orderkey % 997 = 0 THEN 1 ELSE -1 END"


@query("agg_prod", f"SELECT CAST((SELECT product(n_regionkey + 1) FROM nation) AS BIGINT) AS p, CAST(product({_SIGNS}) AS BIGINT) AS signs, CAST(0 AS BIGINT) AS none FROM orders")
def _(spark, sf):
    whole = table(spark, sf, "nation").select((F.col("n_regionkey") + 1).cast("bigint").alias("x"))
    signs = table(spark, sf, "orders").select(F.expr(_SIGNS).cast("bigint").alias("x"), (F.col("o_custkey") * F.expr(f"CASE WHEN {_SIGNS} = 1 THEN 0 ELSE 1 END")).cast("bigint").alias("y"))
    return aggregates.whole(whole, {"p": ("x", "prod")}).crossJoin(aggregates.whole(signs, {"signs": ("x", "prod"), "none": ("y", "prod")}))  # one row each


@query("agg_sum_checked", "SELECT CAST(sum(o_custkey) AS BIGINT) AS s FROM orders")
def _(spark, sf):
    return aggregates.whole(table(spark, sf, "orders"), {"s": ("o_custkey", "sum_checked")})


@query("agg_all_null", "SELECT CAST(0 AS DOUBLE) AS sum, CAST(0 AS DOUBLE) AS mean, CAST(0 AS DOUBLE) AS std, CAST(1 AS DOUBLE) AS prod, CAST(NULL AS DOUBLE) AS min, CAST(NULL AS DOUBLE) AS max, CAST(NULL AS DOUBLE) AS median, CAST(NULL AS DOUBLE) AS first, CAST(0 AS BIGINT) AS nunique")
def _(spark, sf):
    nothing = table(spark, sf, "orders").select("o_orderkey", F.lit(None).cast("double").alias("x"))
    return aggregates.whole(nothing, {h: ("x", h) for h in ("sum", "mean", "std", "prod", "min", "max", "median", "first", "nunique")}, order=["o_orderkey"])


_GROUPED = {
    "sum": "round(coalesce(sum(v), 0), 2)",
    "mean": "round(coalesce(avg(v), 0), 4)",
    "min": "min(v)",
    "max": "max(v)",
    "std": "round(coalesce(stddev_pop(v), 0), 4)",
    "first": "arg_min(v, event_id) FILTER (WHERE v IS NOT NULL)",
    "last": "arg_max(v, event_id) FILTER (WHERE v IS NOT NULL)",
    "median": "round(median(v), 4)",
    "nunique": "count(DISTINCT v)",
}

for _how, _sql in _GROUPED.items():

    @query(f"group_{_how}", f"SELECT k, {_sql} AS v FROM {EVENTS} WHERE k IS NOT NULL GROUP BY k")
    def _(spark, sf, how=_how):
        return aggregates.grouped(events(spark, sf), "k", {"v": ("v", how)}, order=["event_id"]).select("k", _rounded("v", how) if how not in _PLACES else scalar.rounded(F.col("v"), _PLACES[how]).alias("v"))


@query("group_count", f"SELECT k, count(*) AS count FROM {EVENTS} WHERE k IS NOT NULL GROUP BY k")
def _(spark, sf):
    return aggregates.grouped(events(spark, sf), "k", {"count": ("k", "count")})


@query("group_quantile", f"SELECT k, round(quantile_cont(v, 0.75), 4) AS v FROM {EVENTS} WHERE k IS NOT NULL GROUP BY k")
def _(spark, sf):
    return aggregates.grouped(events(spark, sf), "k", {"v": ("v", "quantile")}, q=0.75).withColumn("v", scalar.rounded(F.col("v"), 4))


@query("group_prod", "SELECT n_regionkey, CAST(product(n_nationkey + 1) AS BIGINT) AS p FROM nation GROUP BY n_regionkey")
def _(spark, sf):
    n = table(spark, sf, "nation").select("n_regionkey", (F.col("n_nationkey") + 1).cast("bigint").alias("x"))
    return aggregates.grouped(n, "n_regionkey", {"p": ("x", "prod")})


@query("group_multi", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS q, count(*) AS n, round(avg(l_discount), 6) AS d FROM lineitem GROUP BY ALL")
def _(spark, sf):
    g = aggregates.grouped(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"], {"q": ("l_quantity", "sum"), "n": ("l_quantity", "count"), "d": ("l_discount", "mean")})
    return g.withColumn("q", scalar.rounded(F.col("q"), 2)).withColumn("d", scalar.rounded(F.col("d"), 6))


@query("group_key", "SELECT concat(l_returnflag, '|', l_linestatus) AS _group_key, count(*) AS count FROM lineitem GROUP BY 1")
def _(spark, sf):
    return aggregates.value_counts(aggregates.group_key(table(spark, sf, "lineitem"), ["l_returnflag", "l_linestatus"]), "_group_key")


@query("value_counts", f"SELECT k, count(*) AS count FROM {EVENTS} WHERE k IS NOT NULL GROUP BY k")
def _(spark, sf):
    return aggregates.value_counts(events(spark, sf), "k")


_STATS = {"count": "CAST(count({0}) AS DOUBLE)", "mean": "round(avg({0}), 4)", "std": "round(stddev_pop({0}), 4)", "min": "CAST(min({0}) AS DOUBLE)", "max": "CAST(max({0}) AS DOUBLE)"}


@query("describe", " UNION ALL ".join(f"SELECT '{s}' AS stat, {e.format('c_custkey')} AS c_custkey, {e.format('c_acctbal')} AS c_acctbal FROM customer" for s, e in _STATS.items()))
def _(spark, sf):
    d = aggregates.describe(table(spark, sf, "customer").select("c_custkey", "c_name", "c_acctbal"))
    return d.select("stat", scalar.rounded(F.col("c_custkey"), 4).alias("c_custkey"), scalar.rounded(F.col("c_acctbal"), 4).alias("c_acctbal"))


# positional columns

_RUN = "OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
for _how in ("sum", "min", "max"):

    @query(f"cum_{_how}", f"SELECT event_id, CASE WHEN n IS NOT NULL THEN CAST({_how}(n) {_RUN} AS BIGINT) END AS n FROM {EVENTS}")
    def _(spark, sf, how=_how):
        return positional.cumulative(events(spark, sf), "n", how, ["event_id"]).select("event_id", "n")


_FACTORS = "CASE WHEN event_id % 4001 = 1 THEN -2 WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 3 = 0 THEN -1 ELSE 1 END"


@query("cum_prod", f"SELECT event_id, CASE WHEN x IS NOT NULL THEN CAST(product(x) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS x FROM (SELECT event_id, {_FACTORS} AS x FROM events)")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.expr(_FACTORS).cast("bigint").alias("x"))
    return positional.cumulative(e, "x", "prod", ["event_id"])


@query("cum_sum_partitioned", f"SELECT event_id, CASE WHEN n IS NOT NULL THEN CAST(sum(n) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) END AS n FROM {EVENTS}")
def _(spark, sf):
    return positional.cumulative(events(spark, sf), "n", "sum", ["event_id"], partition_by=["user_id"]).select("event_id", "n")


for _name, _n in (("pos", 3), ("neg", -2)):

    @query(f"shift_{_name}", f"SELECT event_id, {'lag' if _n > 0 else 'lead'}(k, {abs(_n)}) OVER (ORDER BY event_id) AS k FROM {EVENTS}")
    def _(spark, sf, n=_n):
        return positional.shift(events(spark, sf), "k", n, ["event_id"]).select("event_id", "k")


@query("diff", f"SELECT event_id, n - lag(n, 2) OVER (ORDER BY event_id) AS n FROM {EVENTS}")
def _(spark, sf):
    return positional.diff(events(spark, sf), "n", 2, ["event_id"]).select("event_id", "n")


@query("diff_lossy", "SELECT event_id, CASE WHEN d BETWEEN -32768 AND 32767 THEN CAST(d AS SMALLINT) END AS x FROM (SELECT event_id, x - lag(x) OVER (ORDER BY event_id) AS d FROM (SELECT event_id, CAST((user_id * 7919) % 65536 - 32768 AS INTEGER) AS x FROM events))")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", ((F.col("user_id") * 7919) % 65536 - 32768).cast("smallint").alias("x"))
    return positional.diff(e, "x", 1, ["event_id"], lossy=True)


@query("fill_forward", f"SELECT event_id, last_value(n IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS n FROM {EVENTS}")
def _(spark, sf):
    return positional.fill(events(spark, sf), "n", ["event_id"]).select("event_id", "n")


@query("fill_backward", f"SELECT event_id, first_value(n IGNORE NULLS) OVER (ORDER BY event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS n FROM {EVENTS}")
def _(spark, sf):
    return positional.fill(events(spark, sf), "n", ["event_id"], forward=False).select("event_id", "n")


# order

for _name, _dir in (("asc", True), ("desc", False)):

    @query(f"sort_{_name}", f"SELECT o_orderkey, nv, row_number() OVER (ORDER BY nv {'ASC' if _dir else 'DESC'} NULLS LAST, o_orderkey) AS rank FROM {ORDERS}")
    def _(spark, sf, up=_dir):
        found = rows.sort(orders(spark, sf), "nv", up, ["o_orderkey"]).select("o_orderkey", "nv")
        # the comparison ignores order, so the place is a column
        return rows.with_position(found, ["nv", "o_orderkey"], "rank", descending_=not up).withColumn("rank", F.col("rank") + 1)

    @query(f"arg_sort_{_name}", f"SELECT row_number() OVER (ORDER BY nv {'ASC' if _dir else 'DESC'} NULLS LAST, p) - 1 AS rank, p AS position FROM (SELECT nv, row_number() OVER (ORDER BY o_orderkey) - 1 AS p FROM {ORDERS})")
    def _(spark, sf, up=_dir):
        return rows.arg_sort(orders(spark, sf), "nv", up, ["o_orderkey"])


@query("head", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 25")
def _(spark, sf):
    return rows.head(table(spark, sf, "orders"), 25, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("tail", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_orderkey DESC LIMIT 25")
def _(spark, sf):
    return rows.tail(table(spark, sf, "orders"), 25, ["o_orderkey"]).select("o_orderkey", "o_totalprice")


@query("slice", "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 30 OFFSET 100")
def _(spark, sf):
    return rows.slice_rows(table(spark, sf, "orders"), 100, 130, ["o_orderkey"]).select("o_orderkey")


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def _(spark, sf):
    return rows.sort(table(spark, sf, "orders"), "o_totalprice", False, ["o_orderkey"]).limit(10).select("o_orderkey", "o_totalprice")


# sets and nulls


@query("concat", "SELECT c_name AS name, c_custkey AS key FROM customer UNION ALL SELECT s_name, s_suppkey FROM supplier")
def _(spark, sf):
    c = table(spark, sf, "customer").select(F.col("c_name").alias("name"), F.col("c_custkey").alias("key"))
    return sets.concat(c, table(spark, sf, "supplier").select("s_acctbal", F.col("s_suppkey").alias("key"), F.col("s_name").alias("name")))


@query("unique", f"SELECT event_id, k, n FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY event_id) AS r FROM {EVENTS}) WHERE r = 1")
def _(spark, sf):
    return sets.unique(events(spark, sf).select("event_id", "k", "n"), "k", ["event_id"])


@query("drop_nulls", f"SELECT event_id, v FROM {EVENTS} WHERE v IS NOT NULL")
def _(spark, sf):
    return nulls.drop_nulls(events(spark, sf).select("event_id", "v"), "v")


@query("drop_nulls_any", f"SELECT event_id, k, v, n FROM {EVENTS} WHERE k IS NOT NULL AND v IS NOT NULL AND n IS NOT NULL")
def _(spark, sf):
    return nulls.drop_nulls_any(events(spark, sf).select("event_id", "k", "v", "n"))


@query("fill_null", f"SELECT event_id, coalesce(k, 'none') AS k, coalesce(v, -1.5) AS v FROM {EVENTS}")
def _(spark, sf):
    return nulls.fill_null(nulls.fill_null(events(spark, sf).select("event_id", "k", "v"), "k", "none"), "v", -1.5)


# casts


@query("cast_safe", "SELECT n_nationkey, CAST(n_regionkey AS BIGINT) AS n_regionkey FROM nation")
def _(spark, sf):
    return cast.cast_safe(table(spark, sf, "nation").select("n_nationkey", "n_regionkey"), "n_regionkey", "i64")


@query("cast_strict", "SELECT o_orderkey, CAST(o_custkey AS INTEGER) AS o_custkey FROM orders")
def _(spark, sf):
    return cast.cast(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "i32")


@query("cast_lossy_int", f"SELECT event_id, CAST(trunc(v) AS INTEGER) AS v FROM {EVENTS}")
def _(spark, sf):
    return cast.cast_lossy(events(spark, sf).select("event_id", "v"), "v", "i32")


@query("cast_lossy_narrow", "SELECT o_orderkey, CASE WHEN o_custkey <= 127 THEN CAST(o_custkey AS TINYINT) END AS o_custkey FROM orders")
def _(spark, sf):
    return cast.cast_lossy(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "i8")


_TEXTS = "CASE o_orderkey % 5 WHEN 0 THEN ' 12 ' WHEN 1 THEN '17' WHEN 2 THEN '+3' WHEN 3 THEN '4.5' ELSE 'true' END"


@query("cast_lossy_string_int", f"SELECT o_orderkey, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+') THEN CAST(t AS BIGINT) END AS t FROM (SELECT o_orderkey, {_TEXTS} AS t FROM orders)")
def _(spark, sf):
    return cast.cast_lossy(table(spark, sf, "orders").select("o_orderkey", F.expr(_TEXTS).alias("t")), "t", "i64")


@query("cast_string_bool", f"SELECT o_orderkey, t IN ('true', '1') AS t FROM (SELECT o_orderkey, {_TEXTS} AS t FROM orders)")
def _(spark, sf):
    return cast.cast(table(spark, sf, "orders").select("o_orderkey", F.expr(_TEXTS).alias("t")), "t", "bool")


@query("cast_bool_int", "SELECT o_orderkey, CAST(CASE WHEN o_orderstatus = 'O' THEN 1 ELSE 0 END AS INTEGER) AS b FROM orders")
def _(spark, sf):
    return cast.cast(table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderstatus") == "O").alias("b")), "b", "i32")


@query("cast_int_float", "SELECT o_orderkey, CAST(o_custkey AS DOUBLE) AS o_custkey FROM orders")
def _(spark, sf):
    return cast.cast(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "f64")


@query("cast_int_string", "SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey FROM orders")
def _(spark, sf):
    return cast.cast(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), "o_custkey", "string")


# scalar functions

_SCALAR = {
    "identity": "v",
    "negate": "-v",
    "abs": "abs(v)",
    "signum": "CAST(sign(v) AS DOUBLE)",
    "square": "round(v * v, 4)",
    "cube": "round(v * v * v, 4)",
    "reciprocal": "CASE WHEN v = 0 THEN CAST('infinity' AS DOUBLE) ELSE round(1 / v, 8) END",
    "floor": "floor(v)",
    "ceil": "ceil(v)",
    "round": "round(v)",
    "trunc": "trunc(v)",
}

# nulls, zeros and both signs
_CELLS = "CASE WHEN event_type = 'signup' THEN NULL WHEN event_id % 11 = 0 THEN CAST(0 AS DOUBLE) ELSE value - 40.0 END"

for _name, _sql in _SCALAR.items():

    @query(f"apply_{_name}", f"SELECT event_id, {_sql} AS v FROM (SELECT event_id, {_CELLS} AS v FROM events)")
    def _(spark, sf, name=_name):
        e = table(spark, sf, "events").select("event_id", F.expr(_CELLS).alias("v"))
        out = scalar.mapped(e, "v", name)
        return out.withColumn("v", scalar.rounded(F.col("v"), {"square": 4, "cube": 4, "reciprocal": 8}[name])) if name in ("square", "cube", "reciprocal") else out


_EDGES = "CASE event_id % 5 WHEN 0 THEN -2147483648 WHEN 1 THEN 2147483647 WHEN 2 THEN 0 WHEN 3 THEN NULL ELSE CAST(event_id AS INTEGER) END"
_LEAST = "-2147483648"

for _name, _sql in {"negate": f"CASE WHEN v = {_LEAST} THEN v ELSE -v END", "abs": f"CASE WHEN v = {_LEAST} THEN v ELSE abs(v) END", "signum": "CAST(sign(v) AS INTEGER)"}.items():

    @query(f"apply_{_name}_int", f"SELECT event_id, CAST({_sql} AS INTEGER) AS v FROM (SELECT event_id, {_EDGES} AS v FROM events)")
    def _(spark, sf, name=_name):
        return scalar.mapped(table(spark, sf, "events").select("event_id", F.expr(_EDGES).cast("int").alias("v")), "v", name)


@query("clip", f"SELECT event_id, CASE WHEN v IS NOT NULL THEN greatest(10.0, least(60.0, v)) END AS v FROM {EVENTS}")
def _(spark, sf):
    return scalar.clip(events(spark, sf).select("event_id", "v"), "v", 10.0, 60.0)


@query("replace", f"SELECT event_id, CASE WHEN k = 'click' THEN 'tap' ELSE k END AS k FROM {EVENTS}")
def _(spark, sf):
    return scalar.replace(events(spark, sf).select("event_id", "k"), "k", "click", "tap")


@query("replace_many", f"SELECT event_id, CASE n WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 7 THEN 0 ELSE n END AS n FROM {EVENTS}")
def _(spark, sf):
    return scalar.replace_many(events(spark, sf).select("event_id", "n"), "n", [(1, 2), (2, 3), (1, 9), (7, 0)])


# dates, decimals and other kinds


@query("date_parts", "SELECT o_orderkey, CAST(year(d) AS INTEGER) AS y, CAST(month(d) AS INTEGER) AS m, CAST(day(d) AS INTEGER) AS d, d + 30 AS later, CAST(d - DATE '1995-01-01' AS INTEGER) AS days, strftime(d, '%Y-%m-%d') AS text FROM (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders)")
def _(spark, sf):
    d = F.to_date("o_orderdate")
    p = kinds.date_parts(d)
    return table(spark, sf, "orders").select("o_orderkey", p["year"].alias("y"), p["month"].alias("m"), p["day"].alias("d"), kinds.date_add_days(d, 30).alias("later"), kinds.date_diff_days(d, F.lit("1995-01-01").cast("date")).alias("days"), kinds.date_format(d).alias("text"))


@query("time_parts", "SELECT event_id, CAST(hour(ts) AS INTEGER) AS h, CAST(minute(ts) AS INTEGER) AS m, CAST(second(ts) AS INTEGER) AS s FROM events")
def _(spark, sf):
    t = kinds.timestamp_time(F.col("ts"))
    return table(spark, sf, "events").select("event_id", kinds.time_hour(t).alias("h"), kinds.time_minute(t).alias("m"), kinds.time_second(t).alias("s"))


@query("ts_add", "SELECT event_id, ts + INTERVAL 90 SECOND AS later, CAST(ts AS DATE) AS d FROM events")
def _(spark, sf):
    return table(spark, sf, "events").select("event_id", kinds.timestamp_add(F.col("ts"), 90_000_000).alias("later"), kinds.timestamp_date(F.col("ts")).alias("d"))


@query("interval_add", "SELECT o_orderkey, CAST(CAST(o_orderdate AS DATE) + INTERVAL 1 MONTH + INTERVAL 10 DAY AS DATE) AS d, o_orderdate + INTERVAL 1 MONTH + INTERVAL 10 DAY + INTERVAL 5 SECOND AS t FROM orders")
def _(spark, sf):
    i = kinds.interval(1, 10, 5000)
    return table(spark, sf, "orders").select("o_orderkey", kinds.interval_add_to_date(F.to_date("o_orderdate"), i).alias("d"), kinds.interval_add_to_timestamp(F.col("o_orderdate"), i).alias("t"))


@query("decimal_arithmetic", "SELECT o_orderkey, a + b AS s, a - b AS d, a * b AS p FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15, 2)) AS a, CAST(1.25 AS DECIMAL(5, 2)) AS b FROM orders)")
def _(spark, sf):
    a, b = F.col("o_totalprice").cast("decimal(15,2)"), F.lit("1.25").cast("decimal(5,2)")
    return table(spark, sf, "orders").select("o_orderkey", (a + b).alias("s"), (a - b).alias("d"), (a * b).alias("p"))


@query("decimal_div", "SELECT o_orderkey, CAST(CAST((CAST(round(a * 100) AS BIGINT) * 1000) // 700 AS DOUBLE) / 1000 AS DOUBLE) AS q FROM (SELECT o_orderkey, o_totalprice AS a FROM orders)")
def _(spark, sf):
    a = F.col("o_totalprice").cast("decimal(15,2)")
    return table(spark, sf, "orders").select("o_orderkey", kinds.decimal_div(a, F.lit(7).cast("decimal(3,2)"), 3, 2, 2).cast("double").alias("q"))


@query("list_access", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, CAST(embedding[3] AS FLOAT) AS x FROM embeddings")
def _(spark, sf):
    e = F.col("embedding")
    return table(spark, sf, "embeddings").select("vec_id", kinds.list_len(e).alias("n"), kinds.list_at(e, 2).alias("x"))


@query("nested_format", """SELECT n_nationkey, concat('{', n_nationkey, ', "', n_name, '", [', n_regionkey, ', null]}') AS t FROM nation""")
def _(spark, sf):
    n = table(spark, sf, "nation").select("n_nationkey", F.struct("n_nationkey", "n_name", F.array("n_regionkey", F.lit(None).cast("int")).alias("l")).alias("s"))
    return n.select("n_nationkey", kinds.nested_format(F.col("s"), n.schema["s"].dataType).alias("t"))


@query("binary_kinds", "SELECT n_nationkey, CAST(octet_length(encode(n_name)) AS INTEGER) AS n, lower(hex(encode(n_name))) AS h FROM nation")
def _(spark, sf):
    b = F.col("n_name").cast("binary")
    return table(spark, sf, "nation").select("n_nationkey", kinds.bytes_len(b).alias("n"), kinds.bytes_format(b).alias("h"))


_TIMES = "CAST(o_orderkey % 86400 AS BIGINT) * 1000000000 + 7000"


@query("time_add_format", f"SELECT o_orderkey, t + 1500000000 AS later, concat(lpad(CAST(t // 3600000000000 AS VARCHAR), 2, '0'), ':', lpad(CAST(t // 60000000000 % 60 AS VARCHAR), 2, '0'), ':', lpad(CAST(t // 1000000000 % 60 AS VARCHAR), 2, '0'), '.000007000') AS text FROM (SELECT o_orderkey, {_TIMES} AS t FROM orders)")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr(_TIMES).alias("t"))
    return o.select("o_orderkey", kinds.time_add(F.col("t"), 1_500_000_000).alias("later"), kinds.time_format(F.col("t")).alias("text"))


@query("ts_from_format", "SELECT event_id, CAST(ts AS DATE) + INTERVAL 3 HOUR AS t, strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') AS text FROM events")
def _(spark, sf):
    ts = F.col("ts")
    return table(spark, sf, "events").select("event_id", kinds.timestamp_from(kinds.timestamp_date(ts), kinds.time_from(F.lit(3 * 3_600_000), "millis")).alias("t"), kinds.timestamp_format(ts).alias("text"))


@query("decimal_helpers", "SELECT o_orderkey, CAST(a + b AS DECIMAL(17, 2)) AS s, CAST(a - b AS DECIMAL(17, 2)) AS d, CAST(a * b AS DECIMAL(20, 4)) AS p, CAST(a AS DECIMAL(18, 4)) AS wide, CAST(a AS DOUBLE) AS f FROM (SELECT o_orderkey, CAST(o_totalprice AS DECIMAL(15, 2)) AS a, CAST(1.25 AS DECIMAL(5, 2)) AS b FROM orders)")
def _(spark, sf):
    a, b = F.col("o_totalprice").cast("decimal(15,2)"), F.lit("1.25").cast("decimal(5,2)")
    return table(spark, sf, "orders").select("o_orderkey", kinds.decimal_add(a, b, 17, 2).alias("s"), kinds.decimal_sub(a, b, 17, 2).alias("d"), kinds.decimal_mul(a, b, 20, 4).alias("p"), kinds.decimal_rescale(a, 18, 4).alias("wide"), kinds.decimal_to_float(a).alias("f"))


@query("uuid_round_trip", "SELECT o_orderkey, concat(h[1:8], '-', h[9:12], '-', h[13:16], '-', h[17:20], '-', h[21:32]) AS u, h FROM (SELECT o_orderkey, lpad(printf('%x', o_orderkey * 2654435761), 32, '0') AS h FROM orders)")
def _(spark, sf):
    h = F.lpad(F.lower(F.hex(F.col("o_orderkey") * F.lit(2654435761))), 32, "0")
    u = kinds.uuid_from_bytes(F.unhex(h))
    back = kinds.uuid_to_bytes(kinds.uuid_parse(F.upper(u)))
    return table(spark, sf, "orders").select("o_orderkey", u.alias("u"), kinds.bytes_format(back).alias("h"))


@query("binary_slice", "SELECT c_custkey, lower(hex(encode(substr(c_name, 3, 4)))) AS h, CAST(strlen(c_name) AS INTEGER) AS n FROM customer")
def _(spark, sf):
    b = F.col("c_name").cast("binary")
    return table(spark, sf, "customer").select("c_custkey", kinds.bytes_format(kinds.bytes_slice(b, 2, 6)).alias("h"), kinds.bytes_len(b).alias("n"))


@query("struct_map_access", "SELECT o_orderkey, o_custkey AS a, o_orderstatus AS b, CAST(2 AS INTEGER) AS n, o_orderstatus AS k, o_custkey + 1 AS v FROM orders")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.struct("o_custkey", "o_orderstatus").alias("s"), F.create_map(F.lit("z"), "o_custkey", "o_orderstatus", F.col("o_custkey") + 1).alias("m"))
    kind, e = o.schema["s"].dataType, kinds.map_at(F.col("m"), 1)
    return o.select("o_orderkey", kinds.struct_at(F.col("s"), kind, 0).alias("a"), kinds.struct_at(F.col("s"), kind, 1).alias("b"), kinds.map_len(F.col("m")).alias("n"), e["key"].alias("k"), e["value"].alias("v"))


@query("interval_order_format", "SELECT o_orderkey, m * 2629746000 + 10 * 86400000 + 500 AS nominal, concat(m, 'mo 10d 500ms') AS text FROM (SELECT o_orderkey, CAST(o_orderkey % 30 AS BIGINT) AS m FROM orders)")
def _(spark, sf):
    i = kinds.interval(F.col("o_orderkey") % 30, 10, 500)
    return table(spark, sf, "orders").select("o_orderkey", kinds.interval_order(i).alias("nominal"), kinds.interval_format(i).alias("text"))


@query("cast_string_float", f"SELECT o_orderkey, TRY_CAST(trim(t) AS DOUBLE) AS t FROM (SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN '1.5' WHEN 1 THEN '-2e3' ELSE 'x' END AS t FROM orders)")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.expr("CASE o_orderkey % 3 WHEN 0 THEN '1.5' WHEN 1 THEN '-2e3' ELSE 'x' END").alias("t"))
    return cast.cast_lossy(o, "t", "f64")


@query("cast_float_float", "SELECT c_custkey, CAST(c_acctbal AS FLOAT) AS c_acctbal FROM customer")
def _(spark, sf):
    return cast.cast(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_acctbal", "f32")


@query("cast_number_bool", f"SELECT event_id, n <> 0 AS n FROM {EVENTS}")
def _(spark, sf):
    return cast.cast(events(spark, sf).select("event_id", "n"), "n", "bool")


@query("cast_float_string", "SELECT event_id, CAST(h AS VARCHAR) AS h FROM (SELECT event_id, (event_id % 100) + 0.5 AS h FROM events)")
def _(spark, sf):
    return cast.cast(table(spark, sf, "events").select("event_id", ((F.col("event_id") % 100) + F.lit(0.5)).cast("double").alias("h")), "h", "string")


@query("compare_frames", "SELECT TRUE AS same, FALSE AS other, TRUE AS series, FALSE AS shifted")
def _(spark, sf):
    o = orders(spark, sf)
    moved = positional.shift(o, "nv", 1, ["o_orderkey"])
    found = (
        rows.same(o, o.repartition(3), ["o_orderkey"]),
        rows.same(o, rows.apply(o, "nv", lambda c: c + 1), ["o_orderkey"]),
        rows.same_series(o, "nv", o.repartition(5), "nv", ["o_orderkey"]),
        rows.same_series(o, "nv", moved, "nv", ["o_orderkey"]),
    )
    return spark.createDataFrame([found], "same boolean, other boolean, series boolean, shifted boolean")


@query("strict_casts_raise", "SELECT * FROM (VALUES ('i8', TRUE), ('u16', TRUE), ('i64 from text', TRUE)) t(what, raised)")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", (F.col("o_orderkey") * -1).alias("low"), F.lit("12x").alias("t"))
    found = []
    for what, name, kind in (("i8", "o_orderkey", "i8"), ("u16", "low", "u16"), ("i64 from text", "t", "i64")):
        try:
            cast.cast(o, name, kind).write.format("noop").mode("overwrite").save()
            found.append((what, False))
        except Exception:  # the error is the result
            found.append((what, True))
    return spark.createDataFrame(found, "what string, raised boolean")


# files


def _folder(spark: SparkSession) -> str:
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise FrameError("spark.checkpoint.dir must name a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="quarryframe-")
    return f"{base.rstrip('/')}/quarryframe-{uuid.uuid4().hex}"


# a table of all rows, with nulls, that files of text can hold; in a text file a null text is an empty one
_TEXTFILE = f"(SELECT event_id, k, round(v, 3) AS v, n FROM {EVENTS})"


def _textfile(spark: SparkSession, sf: str) -> DataFrame:
    return events(spark, sf).select("event_id", "k", scalar.rounded(F.col("v"), 3).alias("v"), "n")


@query("csv_roundtrip", f"SELECT event_id, coalesce(k, '') AS k, v, n FROM {_TEXTFILE}")
def _(spark, sf):
    csv.write_csv(_textfile(spark, sf), path := _folder(spark))
    return csv.read_csv(spark, path)


@query("csv_position", "SELECT event_id, r - 101 AS at FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS r FROM events) WHERE r > 100")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id")
    csv.write_csv(e.repartitionByRange(3, "event_id").sortWithinPartitions("event_id"), path := _folder(spark))
    return csv.read_csv(spark, path, skip_rows=100, position="at")


for _layout in ("ndjson", "rows", "columns"):

    @query(f"json_{_layout}_roundtrip", f"SELECT event_id, k, v, n FROM {_TEXTFILE}")
    def _(spark, sf, layout=_layout):
        json.write_json(_textfile(spark, sf), path := _folder(spark), layout)
        return json.read_json(spark, path)


@query("parquet_roundtrip", "SELECT * FROM customer")
def _(spark, sf):
    parquet.write_parquet(table(spark, sf, "customer"), path := _folder(spark))
    return parquet.read_parquet(spark, path)


@query("parquet_compat", "SELECT * FROM orders")
def _(spark, sf):
    return parquet.read_parquet(spark, f"{sf}/orders.parquet", compat=True)


@query("parquet_int96", "SELECT event_id, ts FROM events")
def _(spark, sf):
    e = table(spark, sf, "events").select("event_id", F.col("ts").cast("timestamp").alias("ts"))
    parquet.write_parquet(e, path := _folder(spark), emit_int96=True)
    return parquet.read_parquet(spark, path).withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("tdf_roundtrip", f"SELECT event_id, k, v, n, ts FROM {EVENTS} JOIN (SELECT event_id AS e, ts FROM events) ON e = event_id")
def _(spark, sf):
    e = events(spark, sf).drop("user_id").join(table(spark, sf, "events").select("event_id", "ts"), "event_id")
    tdf.write_tdf(e, path := _folder(spark))
    return tdf.read_tdf(spark, path)


@query("generate")
def _(spark, sf):
    return generate.generate(spark, 1000, seed=1)


# the generator's rules: ranges, distributions, and the same frame from every partitioning
@query("generate_rules", "SELECT 5000 AS n, TRUE AS keys, TRUE AS i32, TRUE AS i64, TRUE AS u32, TRUE AS dates, TRUE AS stamps, TRUE AS decimals, TRUE AS words, TRUE AS nulls, TRUE AS again, TRUE AS differs")
def _(spark, sf):
    g = generate.generate(spark, 5000, seed=1)
    same = F.bit_xor(F.xxhash64(*g.columns))
    digest = [x.agg(same).first()[0] for x in (g, generate.generate(spark, 5000, seed=1).repartition(7), generate.generate(spark, 5000, seed=2))]
    share = F.count_if(F.col("c_i64").isNull()) / F.count(F.lit(1))
    return g.agg(
        F.count(F.lit(1)).cast("int").alias("n"),
        (F.bool_and(F.col("c_key").between(0, 5000 // 16 - 1)) & (F.count_if(F.col("c_key").isNull()) == 0)).alias("keys"),
        ((F.min("c_i32") == -(1 << 31)) & (F.max("c_i32") == (1 << 31) - 1)).alias("i32"),
        F.bool_and(F.col("c_i64").between(-(10**9), 10**9)).alias("i64"),
        ((F.min("c_u32") == 0) & (F.max("c_u32") == (1 << 32) - 1)).alias("u32"),
        F.bool_and(F.unix_date("c_date").between(10957, 10957 + 10957)).alias("dates"),
        F.bool_and(F.unix_micros("c_timestamp").between(946_684_800_000_000, 1_893_456_000_000_000)).alias("stamps"),
        F.bool_and(F.abs("c_dec") <= 99_999.99).alias("decimals"),
        F.bool_and(F.col("c_str").rlike("^[a-z]{1,8}$")).alias("words"),
        ((share > 0.1) & (share < 0.2)).alias("nulls"),
        F.lit(digest[0] == digest[1]).alias("again"),
        F.lit(digest[0] != digest[2]).alias("differs"),
    )
