"""Shared helpers: tables in the cluster's shared folder, bounded label samples, Arrow plumbing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text that one vectorised step handles, so that numpy temporaries stay small.
CHUNK_BYTES = 1 << 20
#: Bytes of an Arrow batch that Spark hands to Python (at least one row).
BATCH_BYTES = 1 << 22


#: Bytes of the rows of a table that is broadcast after a look at its size.
BROADCAST = 1 << 20

_own_dir = ""


def tuned(spark: SparkSession) -> None:
    """Settings that the operators rest on: shuffles go with their job, and batches for Python hold few bytes.

    With batches of so many rows alone, long texts would make them as large as memory.
    """
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    tuned(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir); a local one only where unset, in local mode."""
    global _own_dir
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    if not _own_dir:
        _own_dir = tempfile.mkdtemp(prefix="quarryframe-")
    return _own_dir


def materialise(df: DataFrame) -> DataFrame:
    """df written once as Parquet in the shared folder and read back: cuts lineage, survives lost executors.

    Spark deletes the shuffles of the job with its end, as nothing reads them any more.
    """
    spark = df.sparkSession
    tuned(spark)
    path = f"{shared_dir(spark).rstrip('/')}/quarryframe-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small(df: DataFrame, row_bytes: int) -> DataFrame:
    """A written table, marked for broadcast if its rows, of at most row_bytes, hold no more than BROADCAST bytes.

    Beyond that it is joined like any other, by shuffle.
    """
    return F.broadcast(df) if df.count() * row_bytes <= BROADCAST else df


def drop(*tables: DataFrame) -> None:
    """Deletes tables that materialise() wrote and no later step reads."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles() if "/quarryframe-" in f}:
            folder = jvm.org.apache.hadoop.fs.Path(path)
            folder.getFileSystem(conf).delete(folder, True)


def free_name(name: str, taken: Iterable[str]) -> str:
    """name, with underscores before it until no taken name is it, upper and lower case alike."""
    used = {t.lower() for t in taken}
    while name.lower() in used:
        name = "_" + name
    return name


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fold(column: str, modulus: int):
    """crc32 of the id as text, modulo; null ids have none."""
    return F.crc32(F.col(column).cast("string").cast("binary")) % F.lit(modulus)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, bound: int, seed: int = 0, most_bytes: int | None = None) -> DataFrame:
    """At most `bound` labelled rows (doc_id, text, y, w), written: half from each class, chosen by a hash of the id.

    w is the class's count over all usable labels divided by its count here, so that weighted sums keep
    the true share of each class however large the classes are.  most_bytes: texts of a class are taken in
    order of the hash while they hold at most half of it together, for callers that hold them at once.

    Rows whose crc32(doc_id) mod 3 is 1, and null ids or labels, are never taken.  A class with fewer
    rows than its half gives all of them.  Ids with contradicting labels are left out; of a repeated id
    the least text is taken.
    """
    known = (
        labels.select("doc_id", F.col(label).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isin(0, 1) & (fold("doc_id", 3) != 1))
        .groupBy("doc_id")
        .agg(F.min("y").alias("y"), F.max("y").alias("other"))
        .where("y = other")
        .select("doc_id", "y", F.xxhash64("doc_id", F.lit(seed)).alias("h"))
    )
    half = max(1, bound // 2)
    counts = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    parts = []
    for y, n in sorted(counts.items()):
        # the hash threshold keeps the final top-k small; its slack makes a shortfall improbable, not wrong
        share = min(1.0, (half + 10 * half**0.5) / n)
        limit = int(-(2**63) + share * (2**64 - 1))
        rows = known.where(F.col("y") == y)
        if share < 1:
            rows = rows.where(F.col("h") <= F.lit(min(limit, 2**63 - 1)))
        parts.append(rows.orderBy("h", "doc_id").limit(half).withColumn("w", F.lit(n / min(n, half))))
    if not parts:
        return docs.select("doc_id", "text", F.lit(0).alias("y"), F.lit(1.0).alias("w")).limit(0)
    picked = parts[0]
    for p in parts[1:]:
        picked = picked.unionByName(p)
    picked = materialise(picked.select(F.col("doc_id").alias("_id"), "y", "w", "h"))
    # at most `bound` ids of 28 bytes: a proven size; rows of one id combine before they are shuffled
    found = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("_id"))
    rows = materialise(found.groupBy("doc_id", "y", "w", "h").agg(F.min("text").alias("text")))
    drop(picked)
    if most_bytes is not None:
        sizes = rows.select("doc_id", "y", "h", F.coalesce(F.octet_length("text"), F.lit(0)).alias("size")).orderBy("y", "h", "doc_id").collect()  # a row a sampled id
        taken, held, last = dict.fromkeys(counts, 0), dict.fromkeys(counts, 0), {}
        for r in sizes:
            held[r["y"]] += r["size"]
            if held[r["y"]] <= most_bytes // 2:
                taken[r["y"]] += 1
                last[r["y"]] = (r["h"], r["doc_id"])
        within = F.lit(False)
        for y, (h, i) in last.items():
            within |= (F.col("y") == y) & ((F.col("h") < h) | ((F.col("h") == h) & (F.col("doc_id") <= i)))
        weight = F.when(F.col("y") == 0, counts.get(0, 0) / max(1, taken.get(0, 0))).otherwise(counts.get(1, 0) / max(1, taken.get(1, 0)))
        rows = rows.where(within).withColumn("w", F.when(F.lit(max(held.values()) > most_bytes // 2), weight).otherwise(F.col("w")))
    return rows.select("doc_id", "text", "y", "w")


def as_texts(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A text column without nulls (null: empty), as one Arrow array."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def raw(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes and len + 1 offsets of an Arrow string array."""
    _, offsets, data = texts.buffers()
    offs = np.frombuffer(offsets, dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if data is None or len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(data, dtype=np.uint8)[offs[0] : offs[-1]], offs - offs[0]


def chunks(texts: pa.Array, size: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Consecutive slices of about `size` bytes; one longer text is a slice of its own."""
    if len(texts) == 0:
        return
    _, offs = raw(texts)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(offs, offs[start] + size, "right")) - 1)
        yield texts.slice(start, stop - start)
        start = stop


def in_chunks(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """The rows of all batches in slices whose texts (nulls: empty) chunks() cuts, so that results stay small too."""
    for batch in batches:
        at = 0
        for texts in chunks(as_texts(batch.column("text"))):
            yield batch.slice(at, len(texts)), texts
            at += len(texts)
    pa.default_memory_pool().release_unused()


def map_arrow(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    def run(batches):
        for batch in batches:
            if batch.num_rows and (out := function(batch)) is not None:
                yield out

    return df.mapInArrow(run, schema)
