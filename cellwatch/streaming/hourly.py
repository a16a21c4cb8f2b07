"""Hourly activity from a stream of clean rows, and its publication."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from cellwatch.functions.expressions import MEASURES
from cellwatch.operators.clean import clean, with_totals
from cellwatch.sources.activity import FILE_GLOB, RAW_SCHEMA, publish


def read_activity_stream(spark: SparkSession, path: str) -> DataFrame:
    """Clean rows of the daily files that land in a folder."""
    raw = spark.readStream.schema(RAW_SCHEMA).option("header", True).option("pathGlobFilter", FILE_GLOB).csv(path)
    return clean(raw)


def stream_hourly(stream: DataFrame, lateness: str = "2 hours") -> DataFrame:
    """One row per cell and closed hour; rows later than the watermark are left out."""
    sums = stream.withWatermark("timestamp", lateness).groupBy("grid_id", F.window("timestamp", "1 hour").alias("w")).agg(*(F.sum(m).alias(m) for m in MEASURES))
    out = sums.select("grid_id", F.col("w.start").alias("timestamp"), *MEASURES)
    return with_totals(out).withColumns({"date": F.date_format("timestamp", "yyyy-MM-dd"), "hour": F.hour("timestamp")})


def publish_stream(hourly: DataFrame, path: str, checkpoint: str) -> DataStreamWriter:
    """Upsert each micro-batch into the stored fact; a batch that runs again changes nothing."""
    return hourly.writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(lambda batch, _: publish(path, batch))
