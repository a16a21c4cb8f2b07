"""Aggregations over cleaned rows and the hourly fact."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellwatch.functions.expressions import MEASURES, mean
from cellwatch.operators.clean import with_totals


def hourly_grid_summary(clean: DataFrame) -> DataFrame:
    """One row per cell and hour: the measures summed over countries, with totals, date and hour."""
    sums = clean.groupBy("grid_id", "timestamp").agg(*(F.sum(m).alias(m) for m in MEASURES))
    return with_totals(sums).withColumns({"date": F.date_format("timestamp", "yyyy-MM-dd"), "hour": F.hour("timestamp")})


def duplicate_grain(df: DataFrame, keys: tuple[str, ...] = ("grid_id", "timestamp")) -> DataFrame:
    """Keys that occur more than once; a sound fact has none."""
    return df.groupBy(*keys).agg(F.count("*").alias("rows")).where("rows > 1")


def require_unique_grain(df: DataFrame, keys: tuple[str, ...] = ("grid_id", "timestamp")) -> DataFrame:
    if not duplicate_grain(df, keys).isEmpty():
        raise ValueError(f"more than one row for some {', '.join(keys)}")
    return df


def daily_grid_summary(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("grid_id", "date").agg(F.sum("total_activity").alias("daily_total_activity"))


def daily_kpis(hourly: DataFrame) -> DataFrame:
    x = "total_activity"
    return hourly.groupBy("date").agg(F.sum(x).alias("total_activity"), mean(x).alias("mean_activity"), F.max(x).alias("max_activity"))


def grid_kpis(hourly: DataFrame) -> DataFrame:
    """Sum, mean and peak of each cell, largest sum first."""
    x = "total_activity"
    out = hourly.groupBy("grid_id").agg(F.sum(x).alias("total_activity"), mean(x).alias("mean_activity"), F.max(x).alias("max_activity"))
    return out.orderBy(F.desc("total_activity"), "grid_id")


def hour_profile(hourly: DataFrame) -> DataFrame:
    """Total of each hour of the day, busiest first."""
    return hourly.groupBy("hour").agg(F.sum("total_activity").alias("total_activity")).orderBy(F.desc("total_activity"), "hour")


def dashboard_summary(hourly: DataFrame) -> DataFrame:
    return hourly.groupBy("date").agg(F.sum("total_activity").alias("daily_total_activity")).orderBy("date")
