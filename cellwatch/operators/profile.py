"""Profiling of raw and cleaned activity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellwatch.functions.expressions import GRID_MAX, GRID_MIN, MEASURES


def profile(df: DataFrame) -> DataFrame:
    """One row: rows, nulls of each column, negatives of each measure, distinct cells and countries, time range."""
    return df.agg(
        F.count("*").alias("rows"),
        *(F.count_if(F.col(c).isNull()).alias(f"nulls_{c}") for c in ["timestamp", "grid_id", "country_code", *MEASURES]),
        *(F.count_if(F.col(c) < 0).alias(f"negative_{c}") for c in MEASURES),
        F.countDistinct("grid_id").alias("grids"),
        F.countDistinct("country_code").alias("countries"),
        F.min("timestamp").alias("first_time"),
        F.max("timestamp").alias("last_time"),
    )


def duplicate_rows(df: DataFrame) -> DataFrame:
    """How many rows repeat an earlier one in all columns."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("c")).agg(F.coalesce(F.sum(F.col("c") - 1), F.lit(0)).alias("duplicate_rows"))


def cadence(df: DataFrame) -> DataFrame:
    """Whether the distinct times are whole hours without a gap: hour-aligned, and as many as their range has."""
    out = df.agg(
        F.countDistinct("timestamp").alias("hours"),
        F.count_if(F.col("timestamp") != F.date_trunc("hour", "timestamp")).alias("unaligned_rows"),
        ((F.unix_timestamp(F.max("timestamp")) - F.unix_timestamp(F.min("timestamp"))) / 3600 + 1).cast("bigint").alias("expected_hours"),
    )
    return out.withColumn("hourly", (F.col("unaligned_rows") == 0) & (F.col("hours") == F.col("expected_hours")))


def busiest(df: DataFrame, key: str, measure: str = "total_activity") -> DataFrame:
    """The key of the largest sum, the smaller one on ties."""
    sums = df.groupBy(key).agg(F.sum(measure).alias("total"))
    best = sums.agg(F.max_by(F.struct(key, "total"), F.struct("total", F.negative(key))).alias("b"))
    return best.select(F.col(f"b.{key}").alias(key), F.col("b.total").alias("total"))


def ingest_report(df: DataFrame, files: int = 1) -> DataFrame:
    """One row: rows, cells, countries and times of the ingested files, and whether all ids are in range."""
    return df.agg(
        F.count("*").alias("rows"),
        F.lit(files).alias("files"),
        F.countDistinct("grid_id").alias("grids"),
        F.countDistinct("country_code").alias("countries"),
        F.countDistinct("timestamp").alias("intervals"),
        F.min("grid_id").alias("least_grid"),
        F.max("grid_id").alias("largest_grid"),
        (F.count_if(~F.coalesce(F.col("grid_id").between(GRID_MIN, GRID_MAX), F.lit(True))) == 0).alias("ids_in_range"),
    )


def country_fanout(df: DataFrame, keys: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    return df.groupBy(*keys).agg(F.countDistinct("country_code").alias("countries"), F.count("*").alias("rows"))
