"""The feed operators as Structured Streaming: an extension, as the batch forms are the core."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(stream: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """The stream with its event time as a timestamp and a watermark; set once, before the others."""
    return stream.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)


def deduplicated(stream: DataFrame, keys: list[str]) -> DataFrame:
    """The first of equal keys within the watermark; state is dropped behind it."""
    return stream.dropDuplicatesWithinWatermark(keys)


def windowed(stream: DataFrame, time: str, by: str, value: str, width: str = "1 hour") -> DataFrame:
    """Count and mean in tumbling windows, closed by the watermark."""
    return stream.groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select("window.start", by, "n", "mean")
