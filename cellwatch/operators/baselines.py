"""Historical baselines, and the as-of instant."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellwatch.functions.expressions import pop_variance, square
from cellwatch.operators.segments import CHUNK_HOURS, expanding_sums

Instant = dt.datetime | str | None


def as_of_row(fact: DataFrame, as_of: Instant = None) -> DataFrame:
    """One row ``as_of``: the given instant, or the latest time of the data."""
    if as_of is None:
        return fact.agg(F.max("timestamp").alias("as_of"))
    return fact.sparkSession.range(1).select(F.lit(as_of).cast("timestamp").alias("as_of"))


def resolve_as_of(fact: DataFrame, as_of: Instant = None) -> dt.datetime:
    """The instant as a value. One that is not in the data is an error, and so is empty data."""
    found = fact.where(F.col("timestamp") == F.lit(as_of).cast("timestamp")) if as_of is not None else fact
    got = found.agg(F.max("timestamp")).first()[0]
    if got is None:
        raise LookupError("no activity data" if as_of is None else f"no activity at {as_of}")
    return got


def at_as_of(fact: DataFrame, as_of: Instant, condition: Column) -> DataFrame:
    """``fact`` with ``as_of``, where the condition holds; a literal instant reaches the scan, else one row is broadcast."""
    if as_of is not None:
        return fact.withColumn("as_of", F.lit(as_of).cast("timestamp")).where(condition)
    return fact.join(F.broadcast(as_of_row(fact)), condition)  # one row


def snapshot(fact: DataFrame, as_of: Instant = None) -> DataFrame:
    return at_as_of(fact, as_of, F.col("timestamp") == F.col("as_of"))


def baselines(fact: DataFrame, as_of: Instant = None, bucket: str = "all_history", measure: str = "total_activity") -> DataFrame:
    """``(grid_id, n, baseline, mean_square, std)`` of each cell over the hours strictly before as_of; with the bucket
    ``hour_of_day`` only over the same hour of earlier days."""
    if bucket not in ("all_history", "hour_of_day"):
        raise ValueError(f"unknown bucket {bucket}")
    past = F.col("timestamp") < F.col("as_of")
    if bucket == "hour_of_day":
        past = past & (F.hour("timestamp") == F.hour("as_of"))
    rows = at_as_of(fact.select("grid_id", "timestamp", F.col(measure).alias("x")), as_of, past)
    out = rows.groupBy("grid_id").agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(square(rows, "x")).alias("q"))
    n = F.nullif(F.col("n"), F.lit(0))
    return out.select(
        "grid_id", "n", (F.col("s").cast("double") / n).alias("baseline"), (F.col("q").cast("double") / n).alias("mean_square"), F.sqrt(pop_variance(F.col("n"), F.col("s"), F.col("q"))).alias("std")
    )


def expanding_zscores(fact: DataFrame, measure: str = "total_activity", chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """Each row's z-score against all earlier rows of its cell; null without any or without variance. A missing measure counts for nothing.

    Histories are scanned by chunks, see ``segments``.
    """
    rows = fact.select("grid_id", "timestamp", F.col(measure).alias("x"))
    known = lambda c: F.coalesce(c, F.lit(0).cast(rows.select(c).schema[0].dataType))
    rows = expanding_sums(rows, {"n": F.col("x").isNotNull().cast("bigint"), "s": known(F.col("x")), "q": known(square(rows, "x"))}, hours=chunk_hours)
    variance = pop_variance(F.col("n"), F.col("s"), F.col("q"))
    z = F.when(variance > 0, (F.col("x").cast("double") - F.col("s").cast("double") / F.nullif(F.col("n"), F.lit(0))) / F.sqrt(variance))
    return rows.select("grid_id", "timestamp", "n", z.alias("z_score"))


def within_day_baseline(hourly: DataFrame, measure: str = "total_activity") -> DataFrame:
    """Median of the other hours of the same cell and day: at most 24 values are gathered for a row; null for a lone hour."""
    day = Window.partitionBy("grid_id", "date")
    x = F.col(measure).cast("double")
    own = F.row_number().over(day.orderBy(measure, "timestamp"))
    rows = hourly.withColumn("own", own).withColumn("all", F.array_sort(F.collect_list(x).over(day)))
    rest = F.concat(F.slice("all", F.lit(1), F.col("own") - 1), F.slice("all", F.col("own") + 1, F.size("all")))
    rows = rows.withColumn("rest", rest)
    k = F.size("rest")
    low, high = F.get("rest", F.floor((k - 1) / 2).cast("int")), F.get("rest", F.floor(k / 2).cast("int"))
    return rows.withColumn("baseline", F.when(k > 0, (low + high) / 2)).drop("own", "all", "rest")
