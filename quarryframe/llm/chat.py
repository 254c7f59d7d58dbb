"""Chat formatting (operator 5): cumulative-snapshot collapse, then rendering.

A logged conversation is a snapshot if another one goes on from it; of equal ones the smallest id stays.
The rolling hash of a prefix is the exclusive or of 64-bit hashes of (place, role, text), twice with two
seeds, so prefixes add up over slices of turns: no task needs a whole conversation, and a conversation
that holds a third of all turns is dealt like any other.  Rendering gives one row a turn for the same
reason; `transcripts` joins the turns of a conversation for those who know them to be short.

Cases.  Turns are ordered by turn (nulls last), then role and text; equal turns all stay.  A null
conversation id is an id of its own, last in order.  Null role: `unknown`; null text: empty.  Repeated
rows are repeated turns.  An empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryframe.llm import common

#: Turns (by value of turn) that a slice holds.
SLICE = 256
START, MIDDLE, END = "<|im_start|>", "\n", "<|im_end|>\n"


def _turns(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), role, text, h1, h2 (hashes of the prefix that ends here)."""
    rows = conversations.select(
        "conv_id",
        "turn",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
    ).withColumn("slice", F.floor(F.col("turn") / SLICE))
    within = Window.partitionBy("conv_id", "slice").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    counts = rows.groupBy("conv_id", "slice").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy(F.col("slice").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(F.col("conv_id").alias("o_id"), F.col("slice").alias("o_slice"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    placed = (
        rows.withColumn("at", F.row_number().over(within))
        .join(offsets, F.col("conv_id").eqNullSafe(F.col("o_id")) & F.col("slice").eqNullSafe(F.col("o_slice")))
        .withColumn("place", (F.col("at") + F.col("before")).cast("long"))
    )
    hashed = placed.select("conv_id", "slice", "place", "role", "text", *(F.xxhash64(F.lit(seed), "place", "role", "text").alias(f"t{seed}") for seed in (1, 2)))
    sums = hashed.groupBy("conv_id", "slice").agg(F.bit_xor("t1").alias("s1"), F.bit_xor("t2").alias("s2"))
    carried = sums.select(F.col("conv_id").alias("c_id"), F.col("slice").alias("c_slice"), *(F.coalesce(F.bit_xor(f"s{k}").over(earlier), F.lit(0)).alias(f"c{k}") for k in (1, 2)))
    upto = Window.partitionBy("conv_id", "slice").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    return (
        hashed.withColumns({f"x{k}": F.bit_xor(f"t{k}").over(upto) for k in (1, 2)})
        .join(carried, F.col("conv_id").eqNullSafe(F.col("c_id")) & F.col("slice").eqNullSafe(F.col("c_slice")))
        .select("conv_id", "place", "role", "text", *(F.col(f"x{k}").bitwiseXOR(F.col(f"c{k}")).alias(f"h{k}") for k in (1, 2)))
    )


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit(MIDDLE), text, F.lit(END))


def collapse(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, role, text) of the maximal conversations, one row a turn."""
    turns = common.materialise(_turns(conversations))
    ends = turns.groupBy("conv_id").agg(F.max_by(F.struct("place", "h1", "h2"), "place").alias("end")).select("conv_id", "end.*")
    # equal conversations: the smallest id, null last
    first = ends.groupBy("place", "h1", "h2").agg(F.min("conv_id").alias("conv_id"))
    # a prefix that goes on: known by its hashes at a place before its conversation's last
    sizes = ends.select(F.col("conv_id").alias("e_id"), F.col("place").alias("n_turns"))
    inner = turns.join(sizes, F.col("conv_id").eqNullSafe(F.col("e_id"))).where("place < n_turns").select("place", "h1", "h2").distinct()
    kept = first.join(inner, ["place", "h1", "h2"], "left_anti").select(F.col("conv_id").alias("k_id"), F.col("place").alias("n_turns"))
    return turns.join(kept, F.col("conv_id").eqNullSafe(F.col("k_id"))).select("conv_id", "place", "n_turns", "role", "text")


def render(conversations: DataFrame) -> DataFrame:
    """(conv_id, place, n_turns, rendered) of the maximal conversations; joined by place, rendered is the chat."""
    return collapse(conversations).select("conv_id", "place", "n_turns", _rendered(F.col("role"), F.col("text")).alias("rendered"))


def transcripts(conversations: DataFrame) -> DataFrame:
    """(conv_id, n_turns, rendered): whole chats, for conversations that fit in a row."""
    parts = F.array_sort(F.collect_list(F.struct("place", "rendered")))
    return render(conversations).groupBy("conv_id", "n_turns").agg(F.concat_ws("", F.transform(parts, lambda p: p["rendered"])).alias("rendered"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render(common.table(spark, sf_dir, "conversations"))


SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) AS place,
         count(*) OVER (PARTITION BY conv_id) AS n_turns, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text
  FROM conversations
), prefixes AS (
  SELECT conv_id, place, n_turns,
         string_agg(concat(length(role), ':', role, length(text), ':', text), '' ORDER BY place) OVER (PARTITION BY conv_id ORDER BY place) AS prefix
  FROM turns
), ends AS (
  SELECT min(conv_id) AS conv_id, place, prefix FROM prefixes WHERE place = n_turns GROUP BY place, prefix
), kept AS (
  SELECT e.conv_id FROM ends e
  WHERE NOT EXISTS (SELECT 1 FROM prefixes p WHERE p.place = e.place AND p.prefix = e.prefix AND p.place < p.n_turns)
)
SELECT t.conv_id, CAST(t.place AS BIGINT) AS place, CAST(t.n_turns AS BIGINT) AS n_turns,
       concat('<|im_start|>', t.role, chr(10), t.text, '<|im_end|>', chr(10)) AS rendered
FROM turns t JOIN kept k ON t.conv_id = k.conv_id
"""
