"""Grouped aggregates over unbounded frames, with the same null rules as the batch ones."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarryframe.errors import FrameError
from quarryframe.operators import aggregates
from quarryframe.operators.rows import quoted


def grouped_windows(stream: DataFrame, time: str, width: str, late: str, keys: Sequence[str], aggregates_: dict[str, tuple[str, str]]) -> DataFrame:
    """A row for each time window and group; rows with a null key, or later than `late`, are left out.

    Order-dependent and distinct aggregates need all rows of a group at once, so they raise here.
    """
    for _, how in aggregates_.values():
        if how in aggregates.ORDERED or how in ("nunique", "median", "quantile", "prod"):
            raise FrameError(f"{how} has no streaming form")
    present = stream.withWatermark(time, late)
    for k in keys:
        present = present.where(quoted(k).isNotNull())
    window = F.window(quoted(time), width).alias("window")
    columns = [aggregates.aggregate(stream, c, how).alias(n) for n, (c, how) in aggregates_.items()]
    return present.groupBy(window, *(quoted(k) for k in keys)).agg(*columns)


def append_parquet(stream: DataFrame, path: str, checkpoint: str, **trigger: object) -> StreamingQuery:
    """Writes a stream's finished rows to a folder, exactly once; trigger: availableNow=True, processingTime=..."""
    return stream.writeStream.format("parquet").outputMode("append").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start(path)
