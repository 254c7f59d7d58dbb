"""What sources and sinks share: row numbers in file order, and whole files through Spark's file systems."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def with_file_position(df: DataFrame, name: str = "_pos") -> DataFrame:
    """df, read from files, with the 0-based row number by file path and place in the file.

    Splits keep their rows in order; their offsets come from one count a split.  A file that is split in
    another way, or has changed, between the count and the reading raises.
    """
    marked = df.withColumns({"__file": F.col("_metadata.file_path"), "__block": F.col("_metadata.file_block_start"), "__row": F.monotonically_increasing_id()})
    splits = marked.groupBy("__file", "__block").agg(F.count(F.lit(1)).alias("n"), F.min("__row").alias("least")).collect()
    offsets, total = [], 0
    for s in sorted(splits, key=lambda s: (s["__file"], s["__block"])):
        offsets.append((s["__file"], s["__block"], total - s["least"]))
        total += s["n"]
    table = df.sparkSession.createDataFrame(offsets, "__f string, __b long, __offset long")  # a row a split
    joined = marked.join(F.broadcast(table), (F.col("__file") == F.col("__f")) & (F.col("__block") == F.col("__b")), "left")
    moved = F.raise_error(F.concat(F.lit("not split as it was counted: "), "__file")).cast("long")
    return joined.withColumn(name, F.col("__row") + F.coalesce("__offset", moved)).drop("__file", "__block", "__row", "__f", "__b", "__offset")


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def save_bytes(spark: SparkSession, path: str, content: bytes) -> None:
    """One file with the content, wherever Spark's file systems reach."""
    where, system = _path(spark, path)
    out = system.create(where, True)
    try:
        for at in range(0, len(content), 1 << 20):
            out.write(bytearray(content[at : at + (1 << 20)]))
    finally:
        out.close()


def scratch(path: str) -> str:
    """A new folder beside the path, so in the same file system."""
    return f"{path.rstrip('/')}-{uuid.uuid4().hex}.parts"


def part_files(spark: SparkSession, folder: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files of a written folder, in order of the tasks; none if there is no folder."""
    where, system = _path(spark, folder)
    if not system.exists(where):
        return []
    found = [(s.getPath().getName(), s.getPath().toString(), s.getLen()) for s in system.listStatus(where) if s.isFile()]
    return [(path, size) for name, path, size in sorted((f for f in found if f[0].startswith("part-")), key=lambda f: int(f[0].split("-")[1])) if size]


def save_joined(spark: SparkSession, path: str, pieces: Iterable[bytes | tuple[str, int, int]]) -> None:
    """One file of bytes and of stretches (path, start, length) of other files, which are copied as streams."""
    where, system = _path(spark, path)
    copy = spark.sparkContext._jvm.org.apache.commons.io.IOUtils.copyLarge
    out, source, opened = system.create(where, True), None, None
    try:
        for piece in pieces:
            if isinstance(piece, bytes):
                for at in range(0, len(piece), 1 << 20):
                    out.write(bytearray(piece[at : at + (1 << 20)]))
                continue
            name, start, length = piece
            if name != opened:
                if source is not None:
                    source.close()
                part, parts = _path(spark, name)
                source, opened = parts.open(part), name
            source.seek(start)
            copy(source, out, 0, length)
    finally:
        if source is not None:
            source.close()
        out.close()


@contextlib.contextmanager
def opened(spark: SparkSession, path: str) -> Iterator[Callable[[int, int], bytes]]:
    """A function that gives n bytes of the file from a place on."""
    where, system = _path(spark, path)
    source = system.open(where)

    def read(at: int, n: int) -> bytes:
        source.seek(at)
        return bytes(source.readNBytes(n))

    try:
        yield read
    finally:
        source.close()


def remove(spark: SparkSession, folder: str) -> None:
    where, system = _path(spark, folder)
    system.delete(where, True)


def first_bytes(spark: SparkSession, path: str, n: int) -> bytes:
    """The start of the first file at the path that isn't empty."""
    for row in spark.read.format("binaryFile").load(path).where("length > 0").select("path").orderBy("path").limit(1).collect():
        where, system = _path(spark, row["path"])
        source = system.open(where)
        try:
            return bytes(source.readNBytes(n))
        finally:
            source.close()
    return b""


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content binary), a row a file."""
    return spark.read.format("binaryFile").load(path).select("path", "content")
