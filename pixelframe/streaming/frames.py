"""Frames as they arrive: packed images read as a stream, per-frame operators, and windowed statistics of events.

An image's frames are independent, so that any per-image operator runs on a stream as it does on a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.images import FRAME_SCHEMA


def read_frames(spark: SparkSession, folder: str, files_a_batch: int = 100) -> DataFrame:
    """Parquet files of packed frames, as they appear in a folder."""
    return spark.readStream.schema(FRAME_SCHEMA).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def frame_means(frames: DataFrame) -> DataFrame:
    """(set_id, frame, mean) of each frame's bytes, by built-in functions: the sum of byte values over their number."""
    values = F.transform(F.sequence(F.lit(1), F.octet_length("image.data")), lambda k: F.conv(F.hex(F.substring(F.col("image.data"), k, F.lit(1))), 16, 10).cast("int"))
    return frames.select("set_id", "frame", (F.aggregate(values, F.lit(0), lambda a, b: a + b) / F.octet_length("image.data")).alias("mean"))


def event_rates(events: DataFrame, width: str = "10 minutes", late: str = "1 hour") -> DataFrame:
    """(window, event_type, n, total) of events (ts, event_type, value); rows later than the watermark are left out."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total"))
