"""Feeds as streams of landed payload files.

The batch parsers use only row-wise functions, so they apply to a stream as they
are. The newest reading per station is a watermarked aggregation.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def payload_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def land_stations(payloads: DataFrame, parse: Callable[[DataFrame], DataFrame], out: str, checkpoint: str) -> StreamingQuery:
    """Parse new payload files and append their station rows, exactly once per file."""
    return (
        parse(payloads).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_readings(readings: DataFrame, late: str = "10 minutes", every: str = "1 hour") -> DataFrame:
    """``(start, station_id, temp, ts)``: newest reading per station and window.

    Works on a stream (state is bounded by the watermark) and on a batch table.
    """
    return (
        readings.withWatermark("ts", late)
        .groupBy(F.window("ts", every).alias("w"), "station_id")
        .agg(F.max_by("temp", "ts").alias("temp"), F.max("ts").alias("ts"))
        .select(F.col("w.start").alias("start"), "station_id", "temp", "ts")
    )


def newest_reading(readings: DataFrame) -> DataFrame:
    """Batch form over all time: the newest reading per station."""
    return readings.groupBy("station_id").agg(F.max_by("temp", "ts").alias("temp"), F.max("ts").alias("ts"))
