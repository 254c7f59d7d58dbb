"""Mixing sources to target weights (operator 10): subset-sum budget fitting.

Documents are counted by source and exact length in words.  A target of more than a source's size takes
all of it whole times; of what remains, all but HELD times the longest length (at first LONG, if that is less)
is spread over the lengths in proportion, and bounded-knapsack dynamic programming over the lengths fits the
remaining budget.  Which documents of a length are taken follows from a seeded hash of id and text, ranked within slices of that hash,
so that no task needs a whole group.

Cases.  Null and empty texts have size 0 and are never taken.  A null source is one source, last in
order.  Repeated rows are documents of their own; which of rows equal in source, text and id is taken
makes no difference.  Null ids are ranked like any other.  An empty table gives an empty result; other
columns, whatever their names, don't matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryframe.llm import common, textops

#: Weights of the sources in order, repeated; share of all sizes; most copies of a source.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
SEED = 11
#: Slices of the hash in which documents of one source and length are ranked.
SLICES = 1024
#: Budget that is left to the dynamic programme, in longest lengths of a source.
HELD = 8
#: Length in words up to which a source's longest text sets that budget at once.
LONG = 1 << 15
#: Share of a source's budget by which it may be missed without holding back more than LONG sets.
NEAR = 1e-6


def word_counts(texts: pa.Array) -> np.ndarray:
    out = [np.zeros(0, np.int64)]
    for part in common.chunks(texts):
        data, offs = common.raw(part)
        out.append(np.bincount(textops.word_bounds(data, offs)[2], minlength=len(part)))
    return np.concatenate(out)


def targets(sizes: dict[str | None, int]) -> dict[str | None, float]:
    """Each source's words: shares by weight, stopped at MOST times its size, the excess shared anew."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode("utf-8", "surrogatepass")) + [None] * (None in sizes)
    weight = {s: WEIGHTS[i % len(WEIGHTS)] for i, s in enumerate(order)}
    left, open_, out = SHARE * sum(sizes.values()), set(order), {}
    while open_:
        unit = left / sum(weight[s] for s in order if s in open_)
        full = [s for s in order if s in open_ and unit * weight[s] >= MOST * sizes[s]]
        if not full:
            return out | {s: unit * weight[s] for s in open_}
        for s in full:
            out[s] = MOST * sizes[s]
            left -= out[s]
            open_.discard(s)
        left = max(left, 0.0)
    return out


def set_bits(x: int) -> Iterator[np.ndarray]:
    """Positions of the bits of x that are 1, ascending, a slice at a time so that temporaries stay small."""
    data = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    for start in range(0, len(data), 1 << 17):
        part = data[start : start + (1 << 17)]
        if len(at := np.flatnonzero(part)):
            rows, bits = np.nonzero(np.unpackbits(part[at][:, None], axis=1, bitorder="little"))
            yield (start + at[rows]) * 8 + bits


def nearest_subset(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that their sum comes nearest to budget (ties: below); exact.

    A bounded-knapsack programme over sums up to twice the budget, in units of the lengths' greatest common
    divisor, a bit a sum, longest lengths first; it ends as soon as the nearest sum that there can be is reached.
    Of each sum the item that first reached it is kept, so that memory follows the budget, not the items.
    """
    taken = [0] * len(lengths)
    order = sorted((i for i, n in enumerate(lengths) if n > 0 and counts[i] > 0), key=lambda i: -lengths[i])
    if budget <= 0 or not order:
        return taken
    unit = math.gcd(*(lengths[i] for i in order))
    low, over = divmod(budget, unit)
    aim = low if over <= unit - over else low + 1
    top = 2 * budget // unit  # beyond, taking nothing is nearer
    mask, reached = (1 << (top + 1)) - 1, 1
    first = np.zeros(top + 1, np.uint32)  # the item that reached the sum, from 1
    items: list[tuple[int, int]] = []  # length index, documents in the item
    for i in order:
        rest, size = min(counts[i], top // (lengths[i] // unit)), 1
        while rest > 0 and not reached >> aim & 1:
            size = min(size, rest)
            before, reached = reached, (reached | reached << (size * (lengths[i] // unit))) & mask
            items.append((i, size))
            for sums in set_bits(reached ^ before):
                first[sums] = len(items)
            rest -= size
            size *= 2
    goal = aim
    if not reached >> aim & 1:
        below = (reached & ((1 << (low + 1)) - 1)).bit_length() - 1
        higher = reached >> (low + 1)
        above = low + (higher & -higher).bit_length() if higher else top + 1
        goal = below if budget - below * unit <= above * unit - budget else above
    while goal:
        i, size = items[first[goal] - 1]
        taken[i] += size
        goal -= size * (lengths[i] // unit)
    return taken


def spread(lengths: list[int], counts: list[int], words: float) -> list[int]:
    """How many of each length to take for `words` at most, in proportion; what a length leaves goes to the next shorter."""
    size = sum(n * k for n, k in zip(lengths, counts, strict=True))
    taken, due = [0] * len(lengths), 0.0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        if lengths[i] > 0:
            due += lengths[i] * counts[i] * words / size
            taken[i] = min(counts[i], int(due // lengths[i]))
            due -= taken[i] * lengths[i]
    return taken


def fit(lengths: list[int], counts: list[int], target: float) -> tuple[int, list[int]]:
    """Whole copies of everything, and how many documents of each length are taken once more.

    All but HELD times the longest length, or LONG where that is less, is spread in proportion; the remaining
    budget goes through the programme, so its work follows neither the source nor a few very long texts.
    Where that misses the budget by more than NEAR of it, the texts beyond LONG are chosen before the others;
    then more is held back, up to HELD times the longest length.  The nearest try counts.  Each try misses its budget only where no choice of the documents that
    remain meets it.
    """
    size = sum(n * k for n, k in zip(lengths, counts, strict=True))
    if not size:
        return 0, [0] * len(lengths)
    whole = min(int(target // size), int(MOST))
    rest = min(max(target - whole * size, 0.0), float(size)) if whole < MOST else 0.0
    longest = max(lengths)
    words = lambda taken: sum(n * k for n, k in zip(lengths, taken, strict=True))

    def tried(fixed: list[int], free: list[int], held: int) -> tuple[float, list[int]]:
        """How far the choice misses the budget, and the choice: what is fixed, and some of what is free."""
        some = spread(lengths, free, max(0.0, rest - words(fixed) - HELD * held)) if words(free) else [0] * len(free)
        taken = [a + b for a, b in zip(fixed, some, strict=True)]
        more = nearest_subset(lengths, [k - e for k, e in zip(free, some, strict=True)], max(round(rest) - words(taken), 0))
        taken = [a + b for a, b in zip(taken, more, strict=True)]
        return abs(round(rest) - words(taken)), taken

    held = min(longest, LONG)
    best = tried([0] * len(counts), counts, held)
    if best[0] > NEAR * rest and longest > LONG:
        # the long texts' share first, by lengths in units of LONG: the others make up for the rounding
        free = [k if n <= LONG else 0 for n, k in zip(lengths, counts, strict=True)]
        share = max(rest * (1 - words(free) / size), rest - words(free))
        apart = nearest_subset([round(n / LONG) for n in lengths], [k - f for k, f in zip(counts, free, strict=True)], round(share / LONG))
        best = min(best, tried(apart, free, held))
    while best[0] > NEAR * rest and held < longest and HELD * held < rest:
        held = min(longest, held * HELD)
        best = min(best, tried([0] * len(counts), counts, held))
    return whole, best[1]


def allocate(docs: DataFrame, seed: int = SEED, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns of every row with __mix_source, __mix_size, __mix_source_size, __mix_target and __mix_copies (0, 1, 2)."""

    def sizes(names: tuple[str, ...]) -> DataFrame:
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            n = pa.array(word_counts(common.as_texts(batch.column("__mix_text"))), pa.int64())
            return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names) + 2)), n], [*names, "__mix_source", "__mix_hash", "__mix_size"])

        kinds = dict(docs.dtypes)
        schema = ", ".join([f"`{k}` {kinds[k]}" for k in names] + ["__mix_source string", "__mix_hash long", "__mix_size long"])
        return common.map_arrow(docs.select(*names, F.col("source").cast("string").alias("__mix_source"), F.xxhash64("text").alias("__mix_hash"), F.col("text").alias("__mix_text")), one, schema)

    slice_: Column = F.pmod(F.xxhash64("__mix_id", "__mix_hash", F.lit(seed)), F.lit(SLICES))
    ids = sizes(("doc_id",)).withColumnRenamed("doc_id", "__mix_id")
    # documents by source, exact length and slice of the hash: what both the plan and the ranks need
    cells = common.materialise(ids.groupBy("__mix_source", "__mix_size", slice_.alias("__mix_slice")).agg(F.count(F.lit(1)).alias("__mix_n")))
    # a row a source: the table of weights itself is of that size
    total = {r["__mix_source"]: r["n"] for r in cells.groupBy("__mix_source").agg(F.sum(F.col("__mix_size") * F.col("__mix_n")).alias("n")).collect()}
    target = targets(total)

    def plan(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        source = None if pd.isna(key[0]) else key[0]
        rows = rows.sort_values("__mix_size")
        whole, extra = fit(rows["__mix_size"].tolist(), rows["__mix_n"].tolist(), target[source])
        return pd.DataFrame({"__mix_source": source, "__mix_size": rows["__mix_size"], "__mix_source_size": total[source], "__mix_target": float(target[source]), "__mix_whole": whole, "__mix_extra": extra})

    by_length = cells.groupBy("__mix_source", "__mix_size").agg(F.sum("__mix_n").alias("__mix_n"))
    schema = "__mix_source string, __mix_size long, __mix_source_size long, __mix_target double, __mix_whole int, __mix_extra long"
    plans = by_length.groupBy("__mix_source").applyInPandas(plan, schema)  # rows of a source: its distinct lengths
    same = lambda a, b, names: [a[n].eqNullSafe(b[n]) for n in names]
    steps = Window.partitionBy("__mix_source", "__mix_size").orderBy("__mix_slice").rowsBetween(Window.unboundedPreceding, -1)
    before = cells.withColumn("__mix_before", F.coalesce(F.sum("__mix_n").over(steps), F.lit(0)))
    quota = (
        before.join(plans, same(before, plans, ["__mix_source", "__mix_size"]))
        .select(before["__mix_source"].alias("__mix_q_source"), before["__mix_size"].alias("__mix_q_size"), before["__mix_slice"].alias("__mix_q_slice"), "__mix_source_size", "__mix_target", "__mix_whole", (F.col("__mix_extra") - F.col("__mix_before")).alias("__mix_quota"))
    )
    rows = sizes(tuple(dict.fromkeys([*keep, "doc_id"]))).withColumn("__mix_id", F.col("doc_id")).withColumn("__mix_slice", slice_)
    rank = Window.partitionBy("__mix_source", "__mix_size", "__mix_slice").orderBy(F.xxhash64("__mix_id", "__mix_hash", F.lit(seed + 1)), "__mix_id")
    ranked = rows.withColumn("__mix_rank", F.row_number().over(rank))
    match = (ranked["__mix_source"].eqNullSafe(quota["__mix_q_source"])) & (ranked["__mix_size"] == quota["__mix_q_size"]) & (ranked["__mix_slice"] == quota["__mix_q_slice"])
    copies = F.when(F.col("__mix_size") == 0, 0).otherwise(F.col("__mix_whole") + (F.col("__mix_rank") <= F.col("__mix_quota")).cast("int"))
    return ranked.join(quota, match).select(*keep, "__mix_source", "__mix_size", "__mix_source_size", "__mix_target", copies.alias("__mix_copies"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = allocate(common.table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", F.col("__mix_size").alias("size"), F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), (F.col("__mix_size") * F.col("__mix_copies")).alias("taken"))
