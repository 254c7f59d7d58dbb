"""Exact top-k search (operator 6): block-at-a-time pruning.

The components of a vector are its terms and their integer weights.  Equal rows are one, with their number;
rows are dealt into shards by a hash of id and vector.  A shard orders its rows by their heaviest term, cuts
them into blocks, and knows each term's largest and smallest weight in each block.  A query visits the blocks
by their bound, the sum over terms of the most that the term can add; it scores a block through its forward
index (the rows' weights) and stops when the bound falls below its k-th score.  Queries meet shards in
batches of fixed size, so a task holds one shard and one batch, whatever the input; as in a blocked matrix
product, a row travels once for every batch and a query once for every shard, in the smallest integer type.

Cases.  Vectors that are null, or hold a null or a component that is not finite, and rows with a null
id, take no part.  Vectors of other lengths: missing components count as 0; an empty vector scores 0.  A
row isn't its own candidate; a repeated row is one for the other, and each repeated query row gets its
rows.  Ties go to the smaller id.  Fewer than k candidates: all.  Weights and scores are exact at any size;
a score that would be returned and passes 64 bits, which its column can't hold, raises OverflowError.  An
empty table gives an empty result; other columns don't matter.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarryframe.llm import common

K, EVERY, FACTOR = 20, 20, 64
#: Rows of a shard at most, and at least while tasks are fewer than shuffle partitions; queries of a batch; rows of a block.
SHARD, LEAST_SHARD, BATCH, BLOCK = 1 << 17, 1 << 14, 1 << 13, 128
#: Integer types by their bytes; the first byte of a packed vector tells them, 0 stands for decimal text.
_KINDS = {1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}


def _packed(weights: list[int]) -> bytes:
    """Weights in the smallest type that holds them, without the zeros at the end: equal vectors have equal bytes."""
    while weights and not weights[-1]:
        weights.pop()
    peak = max(map(abs, weights), default=0)
    for size, kind in _KINDS.items():
        if peak < 1 << (8 * size - 1):
            return bytes([size]) + np.array(weights, kind).tobytes()
    return b"\0" + ",".join(map(str, weights)).encode()


def _weights(values: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Packed vectors as rows, in the smallest type of all; Python's integers where 64 bits don't hold one."""
    rows = [np.frombuffer(v, _KINDS[v[0]], offset=1) if v[0] else np.array([int(x) for x in v[1:].decode().split(",")], object) for v in values.to_pylist()]
    kind = object if any(r.dtype == object for r in rows) else np.result_type(np.int8, *{r.dtype for r in rows})
    out = np.zeros((len(rows), max((len(r) for r in rows), default=0)), kind)
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def _peak(weights: np.ndarray) -> int:
    return max(abs(int(weights.max())), abs(int(weights.min()))) if weights.size else 0


class Shard:
    """Different rows (id, weights), each `times` there."""

    def __init__(self, ids: np.ndarray, weights: np.ndarray, times: np.ndarray | None = None):
        self.order = order = np.lexsort((ids, weights.argmax(axis=1) if weights.shape[1] else ids))
        self.ids, self.weights = ids[order], weights[order]
        self.times = np.ones(len(ids), np.int64) if times is None else times[order]
        # the place in order of id, so that a score and a place make one number that ranks
        self.place = np.empty(len(ids), np.int64)
        self.place[np.lexsort((order, self.ids))] = np.arange(len(ids))
        self.cuts = np.arange(0, len(ids), BLOCK)
        self.most = np.stack([self.weights[a : a + BLOCK].max(axis=0) for a in self.cuts])
        self.least = np.stack([self.weights[a : a + BLOCK].min(axis=0) for a in self.cuts])

    def search(self, queries: np.ndarray, k: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query index, row index and score of each query's k best rows (ties: smaller id).

        own: the row that is the query itself, or -1; it is left out, unless it is there more than once.
        """
        width = max(self.weights.shape[1], queries.shape[1])
        pad = lambda x: np.concatenate([x, np.zeros((len(x), width - x.shape[1]), x.dtype)], axis=1)
        weights, most, least, queries = pad(self.weights), pad(self.most), pad(self.least), pad(queries)
        n = len(self.ids)
        peak = max(1, _peak(weights)) * max(1, _peak(queries)) * max(1, width)
        wide = peak * (n + 1) >= 1 << 62  # ranks pass 64 bits: Python's integers
        # floats multiply faster, and exactly as long as sums stay below their digits
        kind = object if wide else np.float32 if peak < 1 << 24 else np.float64 if peak < 1 << 53 else np.int64
        q, whole = queries.astype(kind), object if wide else np.int64
        bounds = (np.maximum(q, 0) @ most.T.astype(kind) + np.minimum(q, 0) @ least.T.astype(kind)).astype(whole)
        visit = np.argsort(-bounds, axis=1, kind="stable")
        none = -(peak + 1) * (n + 1) if wide else np.iinfo(np.int64).min
        best = np.full((len(q), k), none, whole)
        row_of = np.argsort(self.place)
        own = np.where(self.times[own] == 1, own, -1)
        open_ = np.arange(len(q))
        for step in range(len(self.cuts)):
            blocks = visit[open_, step]
            floor_ = best[open_].min(axis=1)
            alive = (floor_ == none) | (bounds[open_, blocks] >= floor_ // n)
            open_, blocks = open_[alive], blocks[alive]
            if not len(open_):
                break
            for b in np.unique(blocks):
                mine = open_[blocks == b]
                a = self.cuts[b]
                scores = (q[mine] @ weights[a : a + BLOCK].T.astype(kind)).astype(whole)
                rank = scores * n + (n - 1 - self.place[a : a + BLOCK])
                hit = (own[mine] >= a) & (own[mine] < a + rank.shape[1])
                rank[np.flatnonzero(hit), own[mine][hit] - a] = none
                both = np.concatenate([best[mine], rank], axis=1)
                best[mine] = np.sort(both, axis=1)[:, -k:] if wide else np.partition(both, both.shape[1] - k, axis=1)[:, -k:]
        which, col = np.nonzero(best != none)
        rank = best[which, col]
        return which, row_of[(n - 1 - rank % n).astype(np.int64)], rank // n


def search(rows: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """(query_id, rank, vec_id, score): rows and queries are (vec_id, v binary: packed weights)."""
    alike = lambda df: df.groupBy("vec_id", "v").agg(F.count(F.lit(1)).alias("times"))
    rows, asked = common.materialise(alike(rows)), common.materialise(alike(queries))
    n_rows, n_queries = rows.count(), asked.count()
    if not n_rows or not n_queries:
        return rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    shards = max(-(-n_rows // SHARD), min(common.partitions(rows.sparkSession), -(-n_rows // LEAST_SHARD)))
    batches = -(-n_queries // BATCH)
    of = lambda n, seed: F.pmod(F.xxhash64("vec_id", "v", F.lit(seed)), F.lit(n)).cast("int")
    left = rows.withColumn("shard", of(shards, 1)).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
    right = asked.withColumn("batch", of(batches, 2)).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))

    def pair(found: pa.Table, asks: pa.Table) -> pa.Table:
        schema = pa.schema([("query_id", pa.int64()), ("v", pa.binary()), ("asked", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64()), ("times", pa.int64())])
        if not found.num_rows or not asks.num_rows:
            return schema.empty_table()
        shard = Shard(found["vec_id"].to_numpy(), _weights(found["v"]), found["times"].to_numpy())
        named = zip(found["vec_id"].to_pylist(), found["v"].to_pylist(), strict=True)
        place = dict(zip(named, np.argsort(shard.order).tolist(), strict=True))
        own = np.array([place.get(x, -1) for x in zip(asks["vec_id"].to_pylist(), asks["v"].to_pylist(), strict=True)], np.int64)
        j, r, s = shard.search(_weights(asks["v"]), k, own)
        if any(abs(int(x)) >= 1 << 63 for x in (s.max(initial=0), s.min(initial=0))):
            raise OverflowError("a score beyond 64 bits")
        picked = asks.take(pa.array(j))
        return pa.table([picked["vec_id"], picked["v"].cast(pa.binary()), picked["times"], pa.array(shard.ids[r], pa.int64()), pa.array(s.tolist(), pa.int64()), pa.array(shard.times[r] - (own[j] == r))], schema=schema)

    near = left.groupBy("shard", "batch").cogroup(right.groupBy("shard", "batch")).applyInArrow(pair, "query_id long, v binary, asked long, vec_id long, score long, times long")
    order = Window.partitionBy("query_id", "v").orderBy(F.col("score").desc(), "vec_id")
    each = near.withColumn("time", F.explode(F.sequence(F.lit(1), F.least(F.col("times"), F.lit(k)).cast("int")))).drop("time")
    best = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    repeated = best.withColumn("time", F.explode(F.sequence(F.lit(1), F.col("asked").cast("int"))))
    return repeated.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def integer_vectors(vectors: DataFrame, factor: int = FACTOR) -> DataFrame:
    """(vec_id, v): floor(factor * component), packed, for the rows that take part."""
    plain = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("e"))
    usable = F.col("vec_id").isNotNull() & F.col("e").isNotNull() & F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))

    def pack(batch: pa.RecordBatch) -> pa.RecordBatch:
        # beyond 53 bits a double is whole, and its product may pass all doubles
        v = [_packed([math.floor(factor * x) if abs(x) < 1 << 53 else factor * int(x) for x in row]) for row in batch.column("e").to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column("vec_id"), pa.array(v, pa.binary())], ["vec_id", "v"])

    return common.map_arrow(plain.where(usable).select("vec_id", "e"), pack, "vec_id long, v binary")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = common.materialise(integer_vectors(common.table(spark, sf_dir, "embeddings")))
    return search(rows, rows.where(F.col("vec_id") % EVERY == 0))


SQL = f"""
WITH raw AS (
  SELECT vec_id, unnest(embedding) AS x, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings
), long_form AS (
  SELECT vec_id, CAST(floor({FACTOR} * CAST(x AS DOUBLE)) AS BIGINT) AS x, i FROM raw
), scores AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(sum(q.x * c.x) AS BIGINT) AS score
  FROM long_form q JOIN long_form c ON q.i = c.i AND q.vec_id <> c.vec_id
  WHERE q.vec_id % {EVERY} = 0 GROUP BY q.vec_id, c.vec_id
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scores
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= {K}
"""
