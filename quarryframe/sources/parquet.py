"""Parquet: Spark's own reader and writer; a second reader for annotated types that Spark rejects."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import from_arrow_type

from quarryframe.sources.files import whole_files

#: Rows of a batch that is handed to Spark.
BATCH = 1 << 16
CODECS = {"uncompressed": "uncompressed", "none": "uncompressed", "snappy": "snappy"}


def read_parquet(spark: SparkSession, path: str, compat: bool = False) -> DataFrame:
    """compat: through Arrow, a task a file, for FLOAT16, UUID, TIME in millis or nanos, TIMESTAMP in nanos
    and decimals beyond 38 digits, which become float, canonical string, nanoseconds, nanoseconds, string."""
    return _read_by_arrow(spark, path) if compat else spark.read.parquet(path)


def _plain(kind: pa.DataType) -> tuple[pa.DataType, str | None]:
    """The Arrow type that Spark takes, and the logical name to keep."""
    if isinstance(kind, pa.BaseExtensionType):
        return (pa.string(), "uuid") if kind.extension_name == "arrow.uuid" else _plain(kind.storage_type)
    if pa.types.is_float16(kind):
        return pa.float32(), "f16"
    if pa.types.is_time(kind):
        return pa.int64(), "time"
    if pa.types.is_timestamp(kind) and kind.unit == "ns":
        return pa.int64(), "timestamp_ns"
    if pa.types.is_timestamp(kind):
        return pa.timestamp("us", "UTC" if kind.tz else None), None
    if pa.types.is_decimal(kind) and kind.precision > 38:
        return pa.string(), "wide_decimal"
    if pa.types.is_fixed_size_binary(kind):
        return pa.binary(), "fixed_bytes"
    names = {"uint8": (pa.int16(), "u8"), "uint16": (pa.int32(), "u16"), "uint32": (pa.int64(), "u32"), "uint64": (pa.decimal128(20, 0), "u64")}
    return names.get(str(kind), (kind, None))


def _converted(column: pa.ChunkedArray, kind: pa.DataType, to: pa.DataType, name: str | None) -> pa.ChunkedArray | pa.Array:
    if name == "uuid":
        values = column.combine_chunks()
        storage = values.storage if isinstance(values, pa.ExtensionArray) else values
        text = [None if v is None else f"{v.hex()[:8]}-{v.hex()[8:12]}-{v.hex()[12:16]}-{v.hex()[16:20]}-{v.hex()[20:]}" for v in storage.to_pylist()]
        return pa.array(text, pa.string())
    if name == "time":
        factor = {"s": 10**9, "ms": 10**6, "us": 10**3, "ns": 1}[kind.unit]
        return pc.multiply(column.cast(pa.int32() if kind.bit_width == 32 else pa.int64()).cast(pa.int64()), factor)
    if name == "timestamp_ns":
        return column.cast(pa.int64())
    if name == "f16":
        return pa.array([None if v is None else float(np.float16(v)) for v in column.to_pylist()], pa.float32())
    if name == "wide_decimal":
        return pa.array([None if v is None else str(v) for v in column.to_pylist()], pa.string())
    return column.cast(to)


def _batches(content: pa.Buffer, target: pa.Schema, logical: list[str | None]) -> Iterator[pa.RecordBatch]:
    """A file's rows; its bytes aren't copied, and no more than a batch is decoded at a time."""
    file = pq.ParquetFile(pa.BufferReader(content), pre_buffer=False)
    for part in file.iter_batches(BATCH, use_threads=False):
        table = pa.Table.from_batches([part])
        columns = [_converted(table[f.name], table.schema.field(f.name).type, f.type, n) for f, n in zip(target, logical, strict=True)]
        yield from pa.table(columns, names=target.names).combine_chunks().to_batches()


def _read_by_arrow(spark: SparkSession, path: str) -> DataFrame:
    files = whole_files(spark, path)

    def schemas(batches):
        for batch in batches:
            for content in batch.column("content"):
                found = pq.read_schema(pa.BufferReader(content.as_buffer()))
                sink = pa.schema([pa.field(f.name, _plain(f.type)[0], f.nullable) for f in found]).serialize().to_pybytes()
                yield pa.RecordBatch.from_arrays([pa.array([sink]), pa.array([json.dumps([_plain(f.type)[1] for f in found])])], ["schema", "logical"])

    first = files.limit(1).mapInArrow(schemas, "schema binary, logical string").first()
    target = pa.ipc.read_schema(pa.py_buffer(bytes(first["schema"])))
    logical = json.loads(first["logical"])
    schema = T.StructType([T.StructField(f.name, from_arrow_type(f.type), True, {"logical": n} if n else {}) for f, n in zip(target, logical, strict=True)])

    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                yield from _batches(content.as_buffer(), target, logical)

    out = files.mapInArrow(rows, schema)
    return out.select(*(F.col("`" + f.name + "`").alias(f.name, metadata=f.metadata) for f in schema))


def write_parquet(df: DataFrame, path: str, compression: str = "snappy", emit_int96: bool = False) -> None:
    """emit_int96: timestamps in the legacy 96-bit form."""
    options = {"compression": CODECS.get(compression, compression)}
    if emit_int96:  # an option of this write alone
        options["spark.sql.parquet.outputTimestampType"] = "INT96"
    df.write.mode("overwrite").options(**options).parquet(path)
