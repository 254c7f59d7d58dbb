"""Headline queries, timed: one JSON line.

to Spark's `noop` sink, so all rows are made and none are kept.  The median of $BENCH_RUNS runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryframe.operators import aggregates, cast, joins, nulls, positional, rows
from quarryframe.session import session, ship
from quarryframe.sources import parquet, tdf

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = int(os.environ.get("BENCH_RUNS", "3"))


def main() -> None:
    spark = session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__ui__showConsoleProgress="false", spark__driver__memory="8g")
    spark.sparkContext.setLogLevel("ERROR")
    ship(spark)
    items = spark.read.parquet(f"{SF}/lineitem.parquet")
    orders = spark.read.parquet(f"{SF}/orders.parquet").withColumn("nv", F.when(F.col("o_custkey") % 7 != 0, F.col("o_totalprice")))
    left, right = items.withColumnRenamed("l_orderkey", "k"), orders.withColumnRenamed("o_orderkey", "k")
    folder = tempfile.mkdtemp(prefix="quarryframe-bench-")

    def parquet_roundtrip() -> DataFrame:
        parquet.write_parquet(items, f"{folder}/items", "uncompressed")
        return parquet.read_parquet(spark, f"{folder}/items")

    def tdf_roundtrip() -> DataFrame:
        tdf.write_tdf(items, f"{folder}/items.tdf")
        return tdf.read_tdf(spark, f"{folder}/items.tdf")

    queries = {
        "sort": lambda: rows.sort(items, "l_partkey"),
        "filter": lambda: rows.filter_rows(items, "l_quantity", "gt", 25.0),
        "groupBy_sum": lambda: aggregates.grouped(items, "l_returnflag", {"s": ("l_quantity", "sum")}),
        "join": lambda: joins.join(left, right, "k"),
        "cumSum": lambda: positional.cumulative(orders, "o_custkey", "sum", ["o_orderkey"]),
        "cast": lambda: cast.cast(items, "l_linenumber", "i64"),
        "sum": lambda: aggregates.whole(items, {"v": ("l_extendedprice", "sum")}),
        "mean": lambda: aggregates.whole(items, {"v": ("l_extendedprice", "mean")}),
        "min": lambda: aggregates.whole(items, {"v": ("l_extendedprice", "min")}),
        "max": lambda: aggregates.whole(items, {"v": ("l_extendedprice", "max")}),
        "dropNulls": lambda: nulls.drop_nulls(orders, "nv"),
        "describe": lambda: aggregates.describe(items.select("l_quantity", "l_extendedprice", "l_discount")),
        "parquet_roundtrip": parquet_roundtrip,
        "tdf_roundtrip": tdf_roundtrip,
    }
    took: dict[str, float] = {}
    for name, build in queries.items():
        each = []
        for _ in range(RUNS + 1):  # the first warms up
            began = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            each.append(time.perf_counter() - began)
        took[name] = round(statistics.median(each[1:]), 4)
    print(json.dumps({"metric": "headline queries, sum of medians", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": SF, "lineitem_rows": items.count()}))


if __name__ == "__main__":
    main()
