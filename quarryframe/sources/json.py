"""JSON in three layouts: rows `[{..}]`, ndjson, and columns `{"a": [..]}`.

Cells are read as variants; one pass over all rows finds each column's types: any string makes it string
(others as text), else any fraction or integer beyond 64 bits double (booleans 0.0), else any integer i64
(booleans 1 or 0), else boolean; all null is string.  Columns stand in order of first appearance, which the
keys of the text itself tell, as variants sort theirs.  Rows are in order by `position` alone.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import types
from quarryframe.errors import FrameError
from quarryframe.operators.rows import quoted
from quarryframe.sources.documents import BLOCK, read_cells
from quarryframe.sources.files import first_bytes, part_files, remove, save_joined, scratch, with_file_position

#: Bytes that tell most layouts.
HEAD = 1 << 16


def detect(spark: SparkSession, path: str) -> str:
    """rows if the text starts with `[`; ndjson if two lines or more start with `{`; else columns."""
    head = first_bytes(spark, path, HEAD)
    start = head.lstrip()[:1]
    if start == b"[":
        return "rows"
    if start and len(re.findall(rb"(?:^|[\r\n]) *\{", head)) > 1:
        return "ndjson"
    # a document may be one line, so pieces between commas are read, not lines
    read = spark.read.option("lineSep", ",").text(path)
    pieces = read.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"))
    if not start:
        first = pieces.select(F.ltrim(F.regexp_replace("value", r"[\r\n\t]", "")).alias("v"), "at").where("v != ''").orderBy("at").limit(1).collect()
        if not first:
            return "empty"
        if first[0]["v"].startswith("["):
            return "rows"
    later = pieces.agg(F.sum(F.regexp_count("value", F.lit(r"[\r\n] *\{")))).first()[0] or 0
    starts = pieces.where("block = 0").groupBy("file").agg(F.min_by("value", "at").alias("v"))
    firsts = starts.where(F.startswith(F.ltrim("v"), F.lit("{"))).count()
    return "ndjson" if later + firsts > 1 else "columns"


def _member(v: Column, key: str) -> Column:
    return F.try_variant_get(v, "$['" + key.replace("'", "\\'") + "']", "variant")


def read_json(spark: SparkSession, path: str, layout: str | None = None, position: str | None = None) -> DataFrame:
    """Empty input gives a frame without columns.  position: a column for the row number."""
    layout = layout or detect(spark, path)
    if layout == "empty":
        return spark.createDataFrame([], T.StructType([]))
    if layout == "ndjson":
        lines = with_file_position(spark.read.text(path), "__pos").where("trim(value) != ''")
        cells = _objects(lines.select("__pos", "value"))
    elif layout == "rows":
        _, arrays = read_cells(spark, path, keyed=False)
        cells = _objects(arrays.select("at", F.posexplode("cells")).select((F.col("at") + F.col("pos")).alias("__pos"), F.col("col").alias("value")))
    elif layout == "columns":
        cells = _columns(*read_cells(spark, path, keyed=True))
    else:
        raise FrameError(f"no layout {layout!r}")
    names = [c for c in cells.columns if c != "__pos"]
    kinds = cells.agg(*(F.collect_set(F.regexp_extract(F.schema_of_variant(quoted(c)), r"^([A-Z]+)", 1)).alias(f"k{i}") for i, c in enumerate(names))).first() if names else []
    out = [_typed(quoted(c), set(kinds[i])).alias(c) for i, c in enumerate(names)]
    if position:
        return cells.select(*out, F.col("__pos").alias(position))
    return cells.select(*out)


def _objects(texts: DataFrame) -> DataFrame:
    """From (__pos, value), the text of an object: __pos and a variant column for every key, in order of first appearance."""
    found = texts.select("__pos", F.posexplode(F.json_object_keys("value")).alias("at", "key"))
    firsts = found.groupBy("key").agg(F.min(F.struct("__pos", "at")).alias("first"))
    keys = [r["key"] for r in firsts.orderBy("first", "key").collect()]  # a row a column
    rows = texts.select("__pos", F.parse_json("value").alias("v"))
    return rows.select("__pos", *(_member(F.col("v"), k).alias(k) for k in keys))


def _columns(keys: list[str], arrays: DataFrame) -> DataFrame:
    """Cells of one block of row numbers meet, column by column; the arrays are known to be equally long."""
    blocks = arrays.groupBy("file", F.floor(F.col("at") / BLOCK).alias("block")).agg(*(F.flatten(F.array_sort(F.collect_list(F.when(F.col("key") == i, F.struct("at", "cells"))))["cells"]).alias(f"a{i}") for i in range(len(keys))))
    zipped = blocks.select("block", F.posexplode(F.arrays_zip(*(f"a{i}" for i in range(len(keys)))))) if keys else blocks.select("block", F.lit(0).alias("pos")).limit(0)
    return zipped.select((F.col("block") * BLOCK + F.col("pos")).cast("long").alias("__pos"), *(F.parse_json(F.col(f"col.a{i}")).alias(k) for i, k in enumerate(keys)))


def _typed(c: Column, kinds: set[str]) -> Column:
    kinds = kinds - {"VOID", ""}
    if not kinds or kinds & {"STRING", "OBJECT", "ARRAY"}:
        scalar = F.try_variant_get(c, "$", "string")
        nested = F.schema_of_variant(c).rlike("^(OBJECT|ARRAY)")
        return F.when(nested, F.to_json(c)).otherwise(scalar) if kinds & {"OBJECT", "ARRAY"} else scalar
    is_bool = F.schema_of_variant(c) == "BOOLEAN"
    if kinds & {"DECIMAL", "DOUBLE", "FLOAT"}:
        return F.when(is_bool, F.lit(0.0)).otherwise(F.try_variant_get(c, "$", "double"))
    if "BIGINT" in kinds:
        return F.when(is_bool, F.try_variant_get(c, "$", "boolean").cast("bigint")).otherwise(F.try_variant_get(c, "$", "bigint"))
    return F.try_variant_get(c, "$", "boolean")


def _value(df: DataFrame, name: str, compat: bool) -> Column:
    kind = df.schema[name].dataType
    c = quoted(name)
    if isinstance(kind, T.BooleanType) and compat:
        return c.cast("string")
    if isinstance(kind, T.BinaryType):
        return F.lower(F.hex(c))
    if types.label(df.schema[name]) == "decimal":  # quoted at any scale; wide integers are bare
        return c.cast("string")
    return c


def _object(df: DataFrame, compat: bool) -> Column:
    return F.to_json(F.struct(*(_value(df, c, compat).alias(c) for c in df.columns)), {"ignoreNullFields": "false"})


def to_json_string(df: DataFrame, layout: str = "rows", compat: bool = False) -> str:
    """The whole frame as one string, on the driver: for frames known to be small.  compat: booleans quoted."""
    rows = [r["v"] for r in df.select(_object(df, compat).alias("v")).collect()]
    if layout == "ndjson":
        return "\n".join(rows)
    if layout == "rows":
        return "[" + ",".join(rows) + "]"
    if layout != "columns":
        raise FrameError(f"no layout {layout!r}")
    cells = df.select(*(F.get_json_object(F.to_json(F.struct(F.array(_value(df, c, compat)).alias("a")), {"ignoreNullFields": "false"}), "$.a").alias(c) for c in df.columns)).collect()
    return "{" + ",".join(f"{json.dumps(c, ensure_ascii=False)}:[" + ",".join(r[i][1:-1] for r in cells) + "]" for i, c in enumerate(df.columns)) + "}"


def write_json(df: DataFrame, path: str, layout: str = "ndjson", compat: bool = False) -> None:
    """ndjson: a folder of files; the other layouts are one document, a single file that tasks write in parts."""
    if layout == "ndjson":
        df.select(_object(df, compat).alias("value")).write.mode("overwrite").text(path)
        return
    spark, folder = df.sparkSession, scratch(path)
    try:
        if layout == "rows":
            df.select(_object(df, compat).alias("value")).write.option("lineSep", ",").text(folder)
            save_joined(spark, path, [b"[", *_parted(spark, folder), b"]"])
        elif layout == "columns":
            # {"a":[cell]} without what is around the cell
            texts = [F.to_json(F.struct(F.array(_value(df, c, compat)).alias("a")), {"ignoreNullFields": "false"}) for c in df.columns]
            cells = [F.substring(t, F.lit(7), F.length(t) - 8) for t in texts]
            each = df.select(F.monotonically_increasing_id().alias("at"), F.array(*cells).alias("cells")).select("at", F.posexplode("cells").alias("c", "value"))
            if df.columns:
                each.sortWithinPartitions("c", "at").select("c", "value").write.partitionBy("c").option("lineSep", ",").text(folder)
            pieces = []
            for i, c in enumerate(df.columns):
                name = json.dumps(c, ensure_ascii=False).encode()
                pieces += [b"," if i else b"{", name, b":[", *_parted(spark, f"{folder}/c={i}"), b"]"]
            save_joined(spark, path, [*(pieces or [b"{"]), b"}"])
        else:
            raise FrameError(f"no layout {layout!r}")
    finally:
        remove(spark, folder)


def _parted(spark: SparkSession, folder: str) -> list[tuple[str, int, int]]:
    """The folder's files in order, without the comma at the end of the last."""
    found = part_files(spark, folder)
    return [(path, 0, size - (i == len(found) - 1)) for i, (path, size) in enumerate(found)]
