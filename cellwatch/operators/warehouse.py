"""Dimensions, fact and publication: keys, upserts, added columns, snapshots and integrity."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellwatch.functions.expressions import MEASURES, TOTALS


def time_key(c: str = "timestamp"):
    return F.date_format(c, "yyyyMMddHH").cast("int")


def build_dim_time(hourly: DataFrame) -> DataFrame:
    """One row per distinct hour."""
    hours = hourly.select("timestamp").distinct()
    return hours.select(time_key().alias("time_key"), "timestamp", F.date_format("timestamp", "yyyy-MM-dd").alias("date"), F.hour("timestamp").alias("hour"), F.date_format("timestamp", "EEEE").alias("day_of_week"))


def build_fact(hourly: DataFrame) -> DataFrame:
    """Fact with both its keys, without geometry."""
    return hourly.select("grid_id", time_key().alias("time_key"), "timestamp", *MEASURES, *TOTALS)


def with_timestamp(fact: DataFrame, dim_time: DataFrame | None = None) -> DataFrame:
    """Either fact layout with a ``timestamp``: as it is, or joined from the time dimension."""
    if "timestamp" in fact.columns:
        return fact
    if dim_time is None:
        raise ValueError("a fact without timestamp needs dim_time")
    at = "timestamp" if "timestamp" in dim_time.columns else "ts"
    return fact.join(dim_time.select("time_key", F.col(at).cast("timestamp").alias("timestamp")), "time_key")


def star(fact: DataFrame, dim_time: DataFrame) -> DataFrame:
    """Fact with the columns of its hour; Spark broadcasts the dimension while it is small."""
    return fact.drop("timestamp").join(dim_time, "time_key")


def orphans(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Fact keys that the dimension lacks."""
    return fact.select(key).distinct().join(dim.select(key), key, "left_anti")


def upsert(base: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("grid_id", "timestamp")) -> DataFrame:
    """``base`` with the rows of ``updates`` in place of those of equal keys; doing it again adds nothing."""
    return base.join(updates.select(*keys).distinct(), list(keys), "left_anti").unionByName(updates, allowMissingColumns=True)


def publication_summary(base: DataFrame, updates: DataFrame, keys: tuple[str, ...] = ("grid_id", "timestamp")) -> DataFrame:
    """One row: rows that came in, rows published, rows then in the warehouse, and its latest time."""
    told = updates.agg(F.count("*").alias("rows_in"), F.countDistinct(*keys).alias("rows_published"))
    return told.crossJoin(upsert(base, updates, keys).agg(F.count("*").alias("warehouse_rows"), F.max("timestamp").alias("as_of")))  # one row each


def ensure_columns(df: DataFrame, defaults: dict[str, float]) -> DataFrame:
    """Measures that an older layout lacks are added with their default, which also fills nulls."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(v)) if c in df.columns else F.lit(v) for c, v in defaults.items()})
