"""CSV, JSON, Parquet and TDF: inference, odd cells, errors, and bytes."""

import datetime as dt
import decimal
import json as plain
import struct

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryframe import errors
from quarryframe.sources import csv, files, json, parquet, tdf
from quarryframe.streaming import append_parquet, grouped_windows


def write(path, text):
    path.write_text(text, newline="")
    return str(path)


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_csv_inference(spark, tmp_path):
    p = write(tmp_path / "a.csv", 'a,b,c,d,e\n1,1.5, 7,"x, ""y""",\n,2,,,\n"-3",nan,8,z,\n')
    df = csv.read_csv(spark, p)
    assert [t for _, t in df.dtypes] == ["bigint", "double", "string", "string", "string"]
    got = rows(df)
    assert got[0][:1] + got[0][2:] == (1, " 7", 'x, "y"', "") and got[1] == (None, 2.0, "", "", "") and got[2][0] == -3


def test_csv_big_integers_are_floats_and_skip(spark, tmp_path):
    p = write(tmp_path / "a.csv", "1;99999999999999999999\n2;5\n3;6\n")
    df = csv.read_csv(spark, p, delimiter=";", header=False, skip_rows=1, position="at")
    assert rows(df) == [(2, 5.0, 0), (3, 6.0, 1)]


def test_csv_shape_errors(spark, tmp_path):
    with pytest.raises(errors.InconsistentRowWidth):
        csv.read_csv(spark, write(tmp_path / "a.csv", "a,b\n1,2\n3\n"))
    with pytest.raises(errors.InconsistentRowWidth):
        csv.read_csv(spark, write(tmp_path / "b.csv", "a,b\n1,2\n\n3,4\n"))
    with pytest.raises(errors.EmptyInput):
        csv.read_csv(spark, write(tmp_path / "c.csv", ""))


def test_csv_string(spark):
    df = spark.createDataFrame([("a,b", 1.0, None), ('q"', 2.5, "x")], "s string, x double, t string")
    assert csv.to_csv_string(df) == 's,x,t\n"a,b",1,\n"q""",2.5,x\n'


@pytest.mark.parametrize("text", ['[{"b": 1, "a": "x"}, {"a": null, "c": true}]', '{"b": 1, "a": "x"}\n\n{"a": null, "c": true}\n'])
def test_json_rows(spark, tmp_path, text):
    df = json.read_json(spark, write(tmp_path / "a.json", text))
    assert set(df.columns) == {"a", "b", "c"}
    assert rows(df.select("a", "b", "c")) == [("x", 1, None), (None, None, True)]


def test_json_inference(spark, tmp_path):
    text = '{"i": [1, true, null], "f": [1, 2.5, false], "s": ["x", 2, true], "b": [true, false, null], "n": [null, null, null], "h": [1, 99999999999999999999, 3]}'
    df = json.read_json(spark, write(tmp_path / "a.json", text))
    assert dict(df.dtypes) == {"i": "bigint", "f": "double", "s": "string", "b": "boolean", "n": "string", "h": "double"}
    assert rows(df.select("i", "f", "s"))[1] == (1, 2.5, "2")
    assert rows(df.select("f"))[2] == (0.0,)
    with pytest.raises(errors.RaggedFrame):
        json.read_json(spark, write(tmp_path / "b.json", '{"a": [1], "b": [1, 2]}'))
    assert json.read_json(spark, write(tmp_path / "c.json", "")).columns == []


def test_json_strings(spark):
    df = spark.createDataFrame([(1, True, "é\n"), (None, False, None)], "a int, b boolean, s string")
    assert json.to_json_string(df) == '[{"a":1,"b":true,"s":"é\\n"},{"a":null,"b":false,"s":null}]'
    assert json.to_json_string(df, "ndjson", compat=True).splitlines()[1] == '{"a":null,"b":"false","s":null}'
    assert json.to_json_string(df, "columns") == '{"a":[1,null],"b":[true,false],"s":["é\\n",null]}'


@pytest.mark.parametrize("layout", ["rows", "columns"])
def test_json_documents_are_cut_anywhere(spark, tmp_path, layout):
    """Splits of a few bytes cut within texts, escapes, keys and nested cells; nothing is read whole."""
    cells = [(i, ['a,b"\\\\', "é{[,", None, "}]\\n", "," * 40, ""][i % 6], None if i % 5 == 0 else i / 4, [i, {"x": ",", "y": [1, "]"]}]) for i in range(60)]
    names = ["i", 'k,"e[y', "v", "n"]
    data = [dict(zip(names, c, strict=True)) for c in cells] if layout == "rows" else {n: [c[j] for c in cells] for j, n in enumerate(names)}
    whole = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size, indent in (("37b", None), ("101b", 1), ("1m", None)):
            path = write(tmp_path / f"{layout}{size}.json", " " + plain.dumps(data, ensure_ascii=False, indent=indent) + "\n")
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            assert indent or json.detect(spark, path) == layout
            got = json.read_json(spark, path, layout, position="at").orderBy("at").collect()
            assert [(r["at"], r["i"], r[names[1]], r["v"], plain.loads(r["n"])) for r in got] == [(i, *c) for i, c in enumerate(cells)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", whole)
    for wrong in ("[{}", '[{"a": 1}]]', '[{"a": 1},]', '{"a": [1}') if layout == "rows" else ('{"a": [1]', '{"a": 1}', '{"a": [1,,2]}', '{"a": [1], "a": [2]}'):
        with pytest.raises((errors.FrameError, PySparkException, Py4JJavaError)):
            json.read_json(spark, write(tmp_path / "wrong.json", wrong), layout).collect()


@pytest.mark.parametrize("layout", ["rows", "columns"])
def test_json_documents_are_written_by_tasks(spark, tmp_path, monkeypatch, layout):
    df = spark.range(3000, numPartitions=7).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit('é,"'), "id")).alias("s"), (F.col("id") % 2 == 0).alias("b"))
    expected = json.to_json_string(df, layout, compat=True)
    monkeypatch.setattr(json, "to_json_string", None)  # nothing goes through the driver
    path = tmp_path / "x.json"
    json.write_json(df, str(path), layout, compat=True)
    assert path.read_text() == expected and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.json"]
    json.write_json(df.limit(0), str(path), layout)
    assert path.read_text() == ("[]" if layout == "rows" else '{"id":[],"s":[],"b":[]}') and json.read_json(spark, str(path)).count() == 0


def test_parquet_compat(spark, tmp_path):
    t = pa.table({
        "h": pa.array([1.5, None], pa.float16()),
        "u": pa.array([bytes(range(16)), None], pa.uuid()),
        "t": pa.array([dt.time(0, 0, 1), None], pa.time32("ms")),
        "n": pa.array([1, None], pa.timestamp("ns", "UTC")),
        "d": pa.array([decimal.Decimal("1.5"), None], pa.decimal256(40, 2)),
        "l": pa.array([[1], None], pa.list_(pa.int64())),
        "w": pa.array([7, None], pa.uint64()),
    })
    pq.write_table(t, tmp_path / "x.parquet")
    df = parquet.read_parquet(spark, str(tmp_path / "x.parquet"), compat=True)
    assert rows(df)[0] == (1.5, "00010203-0405-0607-0809-0a0b0c0d0e0f", 10**9, 1, "1.50", [1], decimal.Decimal(7))
    assert rows(df)[1] == (None,) * 7


def test_parquet_compat_reads_in_batches(spark, tmp_path):
    """Files aren't decoded whole: a file of several batches and row groups, and an empty one."""
    t = pa.table({"i": pa.array(range(200_000)), "h": pa.array([None if i % 3 == 0 else i % 100 for i in range(200_000)], pa.float32()).cast(pa.float16()), "s": pa.array([str(i % 7) for i in range(200_000)])})
    pq.write_table(t, tmp_path / "a.parquet", row_group_size=150_000)
    pq.write_table(t.slice(0, 0), tmp_path / "b.parquet")
    target = pa.schema([("i", pa.int64()), ("h", pa.float32()), ("s", pa.string())])
    sizes = [b.num_rows for b in parquet._batches(pa.py_buffer((tmp_path / "a.parquet").read_bytes()), target, [None, "f16", None])]
    assert sum(sizes) == 200_000 and max(sizes) <= parquet.BATCH
    df = parquet.read_parquet(spark, str(tmp_path), compat=True)
    assert df.agg(F.sum("i"), F.count("h"), F.sum("h"), F.count_distinct("s")).first() == (sum(range(200_000)), 133_333, float(sum(i % 100 for i in range(200_000) if i % 3)), 7)


WIDE = T.StructType([
    T.StructField("b", T.BooleanType()), T.StructField("i", T.IntegerType()), T.StructField("l", T.LongType()), T.StructField("f", T.FloatType()), T.StructField("d", T.DoubleType()), T.StructField("s", T.StringType()), T.StructField("day", T.DateType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("dec", T.DecimalType(20, 3)), T.StructField("bin", T.BinaryType()),
    T.StructField("u", T.LongType(), True, {"logical": "u32"}), T.StructField("id", T.StringType(), True, {"logical": "uuid"}),
    T.StructField("iv", T.StructType([T.StructField(n, T.LongType()) for n in ("months", "days", "millis")]), True, {"logical": "interval"}),
    T.StructField("n", T.StructType([T.StructField("xs", T.ArrayType(T.LongType())), T.StructField("m", T.MapType(T.StringType(), T.DoubleType())), T.StructField("name", T.StringType())])),
])
CELLS = [
    (True, -5, 2**62, 1.5, -0.0, "é", dt.date(1960, 2, 3), dt.datetime(1999, 1, 2, 3, 4, 5, 678901), decimal.Decimal("-12.345"), b"\x00\xff", 2**32 - 1, "00112233-4455-6677-8899-aabbccddeeff", (1, 2, 3), ([1, None], {"a": 1.0, "b": None}, "x")),
    (None,) * 14,
    (False, 0, 0, float("inf"), 1e300, "", dt.date(2030, 1, 1), dt.datetime(1970, 1, 1), decimal.Decimal("0.000"), b"", 0, "ffffffff-ffff-ffff-ffff-ffffffffffff", (0, 0, 0), ([], {}, None)),
]


def test_tdf_round_trip(spark, tmp_path):
    df = spark.createDataFrame(CELLS, WIDE)
    path = str(tmp_path / "x.tdf")
    tdf.write_tdf(df, path)
    back = tdf.read_tdf(spark, path, position="at").orderBy("at").drop("at")
    assert [f.metadata for f in back.schema.fields] == [f.metadata for f in WIDE.fields]
    assert back.collect() == df.collect()


def test_tdf_files_are_written_by_tasks(spark, tmp_path, monkeypatch):
    """Blocks of rows that end within a byte of validity, as the same bytes as the frame's on the driver."""
    df = spark.range(1003, numPartitions=5).select("id", F.when(F.col("id") % 3 != 0, F.concat(F.lit("é\n"), "id")).alias("s"), F.when(F.col("id") > 900, F.col("id") / 2).alias("v"), F.array("id").alias("n"))
    for frame in (df, df.limit(0), spark.createDataFrame(CELLS * 9, WIDE).repartition(4).sortWithinPartitions("i").localCheckpoint()):
        expected = tdf.to_tdf_bytes(frame)
        with monkeypatch.context() as m:
            m.setattr(tdf, "to_tdf_bytes", None)  # nothing goes through the driver
            tdf.write_tdf(frame, str(tmp_path / "x.tdf"))
        assert (tmp_path / "x.tdf").read_bytes() == expected and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["x.tdf"]


def test_tdf_header(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id long, name string")
    data = tdf.to_tdf_bytes(df)
    assert data[:24] == tdf.MAGIC + struct.pack("<HHIQ", 1, 0, 2, 2)
    assert data[24:32] == struct.pack("<I", 2) + b"id" + bytes([4, 0])
    assert data.endswith(bytes([1]) + struct.pack("<I", 1) + b"a" + struct.pack("<I", 0))


def test_tdf_malformed(spark):
    data = tdf.to_tdf_bytes(spark.createDataFrame(CELLS, WIDE))
    columns, n = tdf.decode(data)
    assert n == 3 and len(columns) == 14
    for at in range(0, len(data), 3):  # truncated anywhere
        with pytest.raises(errors.CorruptFile):
            tdf.decode(data[:at])
    with pytest.raises(errors.CorruptFile):
        tdf.decode(data + b"x")
    for at in range(len(data)):  # a flipped byte is an error or another frame, never a crash
        try:
            tdf.decode(data[:at] + bytes([data[at] ^ 0xFF]) + data[at + 1 :])
        except errors.CorruptFile:
            pass


def test_file_positions(spark, tmp_path):
    lines = [f"line {i}" for i in range(500)]
    write(tmp_path / "a.txt", "\n".join(lines[:300]) + "\n")
    write(tmp_path / "b.txt", "\n".join(lines[300:]) + "\n")
    found = files.with_file_position(spark.read.text(str(tmp_path))).orderBy("_pos").collect()
    assert [r["value"] for r in found] == lines and [r["_pos"] for r in found] == list(range(500))


def test_stream_of_groups(spark, tmp_path):
    events = spark.createDataFrame([("2024-01-01 00:00:01", "a", 2), ("2024-01-01 00:00:05", "a", None), ("2024-01-01 00:00:07", None, 9), ("2024-01-01 01:00:00", "b", 1)], "t string, k string, v int").withColumn("t", F.col("t").cast("timestamp"))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    events.write.parquet(source)
    stream = grouped_windows(spark.readStream.schema(events.schema).parquet(source), "t", "1 minute", "1 minute", ["k"], {"n": ("k", "count"), "s": ("v", "sum")})
    append_parquet(stream.select("k", "n", "s"), out, str(tmp_path / "check")).awaitTermination()
    assert ("a", 2, 2) in rows(spark.read.parquet(out))
    with pytest.raises(errors.FrameError):
        grouped_windows(events, "t", "1 minute", "1 minute", ["k"], {"m": ("v", "median")})
