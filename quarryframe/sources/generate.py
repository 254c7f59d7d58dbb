"""Seeded synthetic frames for tests and measurements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORDS = ["apple", "birch", "cloud", "delta", "ember", "flint", "grove", "heron", "inlet", "jasper", "kelp", "larch", "maple", "north", "opal", "pine"]


def generate(spark: SparkSession, rows: int, seed: int = 0, null_rate: float = 0.15, lists: bool = False) -> DataFrame:
    """Columns c_key, c_i32, c_i64, c_u32, c_u64, c_f64, c_str, c_date, c_timestamp, c_dec and c_list (optional).

    Every cell is a hash of the row number, the column and the seed, so the frame doesn't depend on partitions.
    """

    def h(tag: str) -> Column:
        return F.xxhash64(F.col("id"), F.lit(tag), F.lit(seed))

    def within(tag: str, n: int) -> Column:
        return F.pmod(h(tag), F.lit(n))

    def maybe(tag: str, c: Column) -> Column:
        return F.when(within(tag + "?", 1_000_000) >= int(null_rate * 1_000_000), c)

    def at_times(tag: str, c: Column, edges: list[object]) -> Column:
        out = F
        for i, e in enumerate(edges):
            out = out.when(within(tag + "!", 100) == i, F.lit(e))
        return out.otherwise(c)

    word = F.element_at(F.array(*map(F.lit, WORDS)), (within("str", len(WORDS)) + 1).cast("int"))
    random_word = F.substring(F.translate(F.sha2(F.concat(F.col("id").cast("string"), F.lit(f"s{seed}")), 256), "0123456789", "ghijklmnop"), F.lit(1), (1 + within("len", 8)).cast("int"))
    columns = {
        "c_key": within("key", max(1, rows // 16)),
        "c_i32": maybe("i32", at_times("i32", (within("i32", 1 << 32) - (1 << 31)).cast("int"), [-(1 << 31), (1 << 31) - 1])),
        "c_i64": maybe("i64", within("i64", 2_000_000_001) - 1_000_000_000),
        "c_u32": maybe("u32", at_times("u32", within("u32", 1 << 32), [0, (1 << 32) - 1])),
        "c_u64": maybe("u64", within("u64", 2_000_000_000).cast("decimal(20,0)")),
        "c_f64": maybe("f64", at_times("f64", (within("f64", 2_000_000_001) - 1_000_000_000) / F.lit(1000.0), [0.0, 1e-9, 1e12])),
        "c_str": maybe("str", F.when(within("pool", 10) < 7, word).otherwise(random_word)),
        "c_date": maybe("date", F.date_from_unix_date((10957 + within("date", 10957)).cast("int"))),
        "c_timestamp": maybe("ts", F.timestamp_micros(946_684_800_000_000 + within("ts", 946_771_200_000_000))),
        "c_dec": maybe("dec", ((within("dec", 19_999_999) - 9_999_999) / F.lit(100).cast("decimal(3,0)")).cast("decimal(9,2)")),
    }
    if lists:
        columns["c_list"] = maybe("list", F.transform(F.slice(F.array(*(F.lit(i) for i in range(4))), F.lit(1), within("n", 5).cast("int")), lambda i: F.pmod(F.xxhash64(F.col("id"), i, F.lit(seed)), F.lit(2001)) - 1000))
    return spark.range(rows).select(*(c.alias(n, metadata={"logical": n[2:]} if n in ("c_u32", "c_u64") else {}) for n, c in columns.items()))
