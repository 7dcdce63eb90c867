"""Structured Streaming over event tables: windowed sums with watermarks, insert-once ids, ingestion by folder.

These go beyond batch evaluation; the same functions work on batch DataFrames where noted.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def read_folder(spark: SparkSession, folder: str, schema: StructType, per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger).parquet(folder)


def windowed(events: DataFrame, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes", at: str = "ts", by: tuple[str, ...] = ("event_type",), value: str = "value") -> DataFrame:
    """Tumbling or sliding windows (batch or stream): counts and sums of a value, late rows beyond the watermark dropped in a stream."""
    frame = events.withWatermark(at, late) if events.isStreaming else events
    w: Column = F.window(at, length, slide) if slide else F.window(at, length)
    return frame.groupBy(w.alias("w"), *by).agg(F.count("*").alias("n"), F.sum(F.round(value, 6).cast("decimal(28,6)")).alias("total")).select(F.col("w.start").alias("start"), *by, "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "10 minutes", at: str = "ts", by: str = "user_id") -> DataFrame:
    """Sessions of each key that end after a gap (batch or stream)."""
    frame = events.withWatermark(at, late) if events.isStreaming else events
    return frame.groupBy(F.session_window(at, gap).alias("s"), by).agg(F.count("*").alias("n")).select(by, F.col("s.start").alias("start"), F.col("s.end").alias("end"), "n")


def insert_once(events: DataFrame, key: str, late: str = "1 hour", at: str = "ts") -> DataFrame:
    """The first row of each id within the watermark."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark([key])


def throttled(requests: DataFrame, by: str = "host", key: str = "request_id", at: str = "ts", spacing: float = 0.25) -> DataFrame:
    """When each request of a stream (key, by, at) may go out: no sooner than it came, and `spacing` seconds after the one before to the
    same host. The last time of each host is the state; requests of one micro-batch go in order of time and key."""
    kind = requests.schema[key].dataType.simpleString()

    def place(host: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(frames)).sort_values([at, key], kind="stable")
        times = []
        for came in rows[at]:
            stamp = came.timestamp()
            last = stamp if last is None else max(stamp, last + spacing)
            times.append(last)
        state.update((last,))
        yield pd.DataFrame({by: host[0], key: rows[key].to_numpy(), "go_at": times})

    return requests.groupBy(by).applyInPandasWithState(place, f"{by} string, {key} {kind}, go_at double", "last double", "append", "NoTimeout")


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Hands each micro-batch to a function, once all that is there has been read."""
    return stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
