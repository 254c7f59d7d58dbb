"""JSON texts that are one document, read and cut by many tasks.

A document is an array of cells, or an object of such arrays.  Spark reads it in pieces between commas, whatever
they separate.  Quotes and brackets of a split tell how it changes the state of a parser, whichever it starts
in; folded over the splits, a row a split, they give each split its own state.  A second pass finds which arrays a
split holds and how many cells come before, a third gives the cells; those cut by a split's end are put together
by their number.  No task and no driver holds a document.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.errors import FrameError, RaggedFrame

#: Cells of an array that travel together.
BLOCK = 4096
_DEPTH, _SPECIAL = np.zeros(256, np.int8), np.zeros(256, bool)
_DEPTH[list(b"[{")], _DEPTH[list(b"]}")] = 1, -1
_SPECIAL[list(b"[]{},")] = True
_ESCAPE = re.compile(rb"\\.", re.DOTALL)


def _pieces(spark: SparkSession, path: str) -> DataFrame:
    """(value, file, block): pieces between commas, in order within a split."""
    found = spark.read.option("lineSep", ",").text(path)
    return found.select(F.col("value").cast("binary").alias("value"), F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"))


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], bytes]]:
    """(split, text): each piece with the comma before it; only a file's first has none."""
    seen = None
    for batch in batches:
        values = batch.column("value").to_pylist()
        files, blocks = (batch.column(n).to_numpy() for n in ("file", "block"))
        cuts = np.flatnonzero((files[1:] != files[:-1]) | (blocks[1:] != blocks[:-1])) + 1
        for a, b in zip([0, *cuts], [*cuts, len(values)], strict=True):
            if a < b:
                split = int(files[a]), int(blocks[a])
                text = b",".join(values[a:b])
                yield split, text if split != seen and split[1] == 0 else b"," + text
                seen = split


def _inside(text: bytes, inside: int) -> tuple[np.ndarray, np.ndarray]:
    """The text's bytes, and for each whether it is in a string; inside: whether the text starts in one."""
    plain = np.frombuffer(_ESCAPE.sub(b"__", text) if b"\\" in text else text, np.uint8)
    return plain, (np.cumsum(plain == 34, dtype=np.uint8) + np.uint8(inside)) & 1


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row a split: whether it ends another string state than it starts, and its change of depth if it starts outside and inside."""
    out: dict[tuple, list[int]] = defaultdict(lambda: [0, 0, 0])
    for split, text in _texts(batches):
        state = out[split]
        plain, within = _inside(text, state[0])
        depth = _DEPTH[plain]
        outside = int(depth[within == 0].sum(dtype=np.int64))
        state[1] += outside
        state[2] += int(depth.sum(dtype=np.int64)) - outside
        state[0] = int(within[-1]) if len(within) else state[0]
    yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "turns": t, "outside": o, "inside": i} for (f, b), (t, o, i) in out.items()], pa.schema([(n, pa.int64()) for n in ("file", "block", "turns", "outside", "inside")]))


def _events(batches: Iterator[pa.RecordBatch], states: dict, level: int) -> Iterator[tuple[tuple[int, int], str, object]]:
    """(split, event, value): outer text above the arrays of cells; open; parts of cells, between the commas that part cells; close."""
    at: dict[tuple, tuple[int, int]] = {}
    for split, text in _texts(batches):
        inside, depth = at.get(split) or states[split]
        plain, within = _inside(text, inside)
        marks = np.flatnonzero(_SPECIAL[plain] & (within == 0))
        change = _DEPTH[plain[marks]].astype(np.int64)
        after = depth + np.cumsum(change)
        commas = marks[(change == 0) & (after == level)]
        turns = np.flatnonzero(((change == 1) & (after == level)) | ((change == -1) & (after == level - 1)))
        start, in_array = 0, depth >= level
        for turn in [*turns, None]:
            end = len(text) if turn is None else int(marks[turn])
            opens = turn is not None and change[turn] == 1
            if in_array:
                cuts = commas[np.searchsorted(commas, start) : np.searchsorted(commas, end)].tolist()
                yield split, "cells", [text[a:b] for a, b in zip([start, *(c + 1 for c in cuts)], [*cuts, end], strict=True)]
                if turn is not None:
                    yield split, "close", None
                start = end
            else:
                stop = end + 1 if opens else end
                yield split, "outer", text[start:stop]
                if opens:
                    yield split, "open", None
                start = stop
            in_array = opens
        at[split] = int(within[-1]) if len(within) else inside, int(after[-1]) if len(after) else depth


def _contents(batches: Iterator[pa.RecordBatch], states: dict, level: int) -> Iterator[pa.RecordBatch]:
    """A row a split: as JSON the list of outer texts, and of arrays as [opened here, commas, whether anything is in it]."""
    out: dict[tuple, list] = defaultdict(list)
    for split, event, value in _events(batches, states, level):
        found = out[split]
        if event == "outer":
            found.append(value.decode(errors="replace"))
        elif event == "open":
            found.append([True, 0, False])
        elif event == "cells":
            if not found or isinstance(found[-1], str):
                found.append([False, 0, False])
            found[-1][1] += len(value) - 1
            found[-1][2] |= len(value) > 1 or bool(value[0].strip())
    yield pa.RecordBatch.from_pylist([{"file": f, "block": b, "found": json.dumps(v)} for (f, b), v in out.items()], pa.schema([("file", pa.int64()), ("block", pa.int64()), ("found", pa.string())]))


def _cells(batches: Iterator[pa.RecordBatch], states: dict, level: int, plan: dict) -> Iterator[pa.RecordBatch]:
    """(file, key, at, seq, whole, cells): cells from number `at` on, of one block; or a part of the cell `at`, parts in order of seq.

    plan: for each split its arrays as (key, number of the first cell), key None for an empty one.
    """
    schema = pa.schema([("file", pa.int64()), ("key", pa.int32()), ("at", pa.int64()), ("seq", pa.int64()), ("whole", pa.bool_()), ("cells", pa.list_(pa.string()))])

    def batch(split: tuple, key: int, at: int, whole: bool, cells: list[bytes]) -> pa.RecordBatch:
        first = BLOCK - at % BLOCK
        cuts = [0, *range(first, len(cells), BLOCK), len(cells)]
        n = len(cuts) - 1
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(cells, pa.binary()).view(pa.string()))
        columns = [pa.array([split[0]] * n, pa.int64()), pa.array([key] * n, pa.int32()), pa.array([at + c for c in cuts[:-1]], pa.int64()), pa.array([split[1]] * n, pa.int64()), pa.array([whole] * n), lists]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    current, number, array, at, cut, pending = None, -1, None, 0, False, []
    for split, event, value in _events(batches, states, level):
        if split != current:
            if pending and array is not None:
                yield batch(current, array, at, False, [b"".join(pending)])
            current, number, array, pending = split, -1, None, []
        if event == "open" or (event == "cells" and array is None and number < 0 and states[split][1] >= level):
            number += 1
            array, at = plan[split][number]
            cut, pending = event != "open", []
        if event == "cells" and array is not None:
            pending.append(value[0])
            if len(value) > 1:
                first = b"".join(pending)
                if cut:
                    yield batch(split, array, at, False, [first])
                    done, at = value[1:-1], at + 1
                else:
                    done = [first, *value[1:-1]]
                if done:
                    yield batch(split, array, at, True, done)
                at, cut, pending = at + len(done), False, [value[-1]]
        if event == "close":
            if array is not None:
                yield batch(split, array, at, not cut, [b"".join(pending)])
            array, pending = None, []
    if pending and array is not None:
        yield batch(current, array, at, False, [b"".join(pending)])


def read_cells(spark: SparkSession, path: str, keyed: bool) -> tuple[list[str], DataFrame]:
    """Names and (file, key, at, cells): the cells of an array (keyed: of the arrays of an object, key the place in names) from number `at` on, as texts."""
    level = 2 if keyed else 1
    pieces = _pieces(spark, path)
    found = pieces.mapInArrow(_changes, "file long, block long, turns long, outside long, inside long").collect()  # a row a split
    states, now = {}, {}
    for r in sorted(found, key=lambda r: (r["file"], r["block"])):
        inside, depth = now.get(r["file"], (0, 0))
        states[r["file"], r["block"]] = inside, depth
        now[r["file"]] = inside ^ r["turns"], depth + (r["inside"] if inside else r["outside"])
    if any(state != (0, 0) for state in now.values()):
        raise FrameError("the document doesn't end")
    contents = pieces.mapInArrow(lambda batches: _contents(batches, states, level), "file long, block long, found string").collect()  # a row a split
    files: dict[int, dict] = defaultdict(lambda: {"outer": [], "sizes": [], "splits": []})
    for r in sorted(contents, key=lambda r: (r["file"], r["block"])):
        file, arrays = files[r["file"]], []
        for item in json.loads(r["found"]):
            if isinstance(item, str):
                file["outer"].append(item)
                continue
            opened, commas, filled = item
            if opened:
                file["sizes"].append([0, False])
            arrays.append((len(file["sizes"]) - 1, file["sizes"][-1][0]))
            file["sizes"][-1][0] += commas
            file["sizes"][-1][1] |= filled
        file["splits"].append(((r["file"], r["block"]), arrays))
    names: list[str] = []
    plan: dict[tuple, list] = {}
    for file in files.values():
        try:
            outer = json.loads("".join(file["outer"]), object_pairs_hook=list)
        except ValueError as e:
            raise FrameError("no document of this layout") from e
        fits = isinstance(outer, list) and all(value == [] and isinstance(key, str) for key, value in outer) if keyed else outer == []
        if not fits or len(file["sizes"]) != (len(outer) if keyed else 1):
            raise FrameError("no document of this layout")
        keys = [key for key, _ in outer] if keyed else [""]
        if len(set(keys)) < len(keys):
            raise FrameError("a key stands twice")
        sizes = [commas + 1 if filled else 0 for commas, filled in file["sizes"]]
        names += [k for k in keys if k not in names]
        if keyed and (len(set(sizes)) > 1 or file is not next(iter(files.values())) and set(keys) != set(names)):
            raise RaggedFrame("columns of unequal length")
        for split, arrays in file["splits"]:
            plan[split] = [(names.index(keys[i]) if sizes[i] else None, at) for i, at in arrays]
    if keyed and any(len(json.loads("".join(f["outer"]), object_pairs_hook=list)) != len(names) for f in files.values()):
        raise RaggedFrame("columns of unequal length")
    cells = pieces.mapInArrow(lambda batches: _cells(batches, states, level, plan), "file long, key int, at long, seq long, whole boolean, cells array<string>")
    # at most two parts a split and array
    parts = cells.where("NOT whole").groupBy("file", "key", "at").agg(F.array_sort(F.collect_list(F.struct("seq", F.col("cells")[0].alias("text")))).alias("parts"))
    joined = parts.select("file", "key", "at", F.array(F.array_join("parts.text", "")).alias("cells"))
    return names, cells.where("whole").select("file", "key", "at", "cells").unionAll(joined)
