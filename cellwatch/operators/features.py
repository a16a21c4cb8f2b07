"""Rolling features of each cell and hour, next-hour labels, and leakage checks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from cellwatch.functions.expressions import FEATURES, WINDOW_HOURS, mean, pop_variance, ratio, square
from cellwatch.operators.segments import CHUNK_HOURS, by_chunk, with_halo

_HOUR = 3600


def _by_time() -> WindowSpec:
    return Window.partitionBy("grid_id").orderBy("epoch")


def trailing(hours: int = WINDOW_HOURS, over: WindowSpec | None = None) -> WindowSpec:
    """The last hours up to and with the row's own, by time and not by rows."""
    return (over or _by_time()).rangeBetween(-(hours - 1) * _HOUR, 0)


def before_trailing(hours: int = WINDOW_HOURS, over: WindowSpec | None = None) -> WindowSpec:
    """As many hours before those."""
    return (over or _by_time()).rangeBetween(-(2 * hours - 1) * _HOUR, -hours * _HOUR)


def build_features(fact: DataFrame, hours: int = WINDOW_HOURS, chunk_hours: int = CHUNK_HOURS) -> DataFrame:
    """The six features of every observed hour, from two range frames that share one sort.

    A cell's history is cut into chunks with a halo, see ``segments``, so both frames of a row lie within its chunk's rows.

    A ratio with a denominator of 0 or without one is null. Windows may be incomplete; the status is ``ok``
    only if both hold a row for every hour. Missing measures count as 0.
    """
    zero = lambda c: F.coalesce(c, F.lit(0).cast(fact.schema[c].dataType)).alias(c)
    rows = with_halo(fact.select("grid_id", "timestamp", zero("total_activity"), zero("internet_activity")), 2 * hours - 1, hours=chunk_hours)
    now, past = trailing(hours, by_chunk()), before_trailing(hours, by_chunk())
    x = F.col("total_activity")
    rows = rows.withColumns(
        {
            "n": F.count("*").over(now), "s": F.sum(x).over(now), "q": F.sum(square(rows, "total_activity")).over(now), "top": F.max(x).over(now),
            "active": F.count_if(x > 0).over(now), "net": F.sum("internet_activity").over(now), "n0": F.count("*").over(past), "s0": F.sum(x).over(past),
        }
    ).where("NOT halo")
    avg = F.col("s").cast("double") / F.col("n")
    base = F.col("s0").cast("double") / F.nullif(F.col("n0"), F.lit(0))
    std = F.sqrt(pop_variance(F.col("n"), F.col("s"), F.col("q")))
    return rows.select(
        "grid_id",
        F.col("timestamp").alias("feature_timestamp"),
        avg.alias("avg_activity"),
        ratio(avg - base, base).alias("activity_growth"),
        F.col("active").cast("int").alias("active_hours"),
        ratio(F.col("top"), avg).alias("peak_ratio"),
        ratio(std, avg).alias("variability"),
        ratio(F.col("net"), F.col("s")).alias("internet_share"),
        F.when((F.col("n") >= hours) & (F.col("n0") >= hours), "ok").otherwise("insufficient_data").alias("data_quality_status"),
        F.col("n").cast("int").alias("row_count"),
    )


def latest_per_grid(features: DataFrame) -> DataFrame:
    """The latest feature row of each cell."""
    last = features.groupBy("grid_id").agg(F.max_by(F.struct(*features.columns), "feature_timestamp").alias("r"))
    return last.select("r.*")


def feature_summary(features: DataFrame) -> DataFrame:
    return features.agg(
        F.count("*").alias("rows"), F.countDistinct("grid_id").alias("grids"), F.min("feature_timestamp").alias("first_time"), F.max("feature_timestamp").alias("last_time"),
        F.count_if(F.col("data_quality_status") == "ok").alias("ok_rows"),
    )


def next_hour_labels(features: DataFrame, fact: DataFrame) -> DataFrame:
    """Feature rows with their cell's activity exactly one hour later; without that hour a row has no label and goes."""
    later = fact.select("grid_id", F.col("timestamp").alias("label_timestamp"), F.col("total_activity").alias("next_hour_activity"))
    at = features.withColumn("label_timestamp", F.col("feature_timestamp") + F.expr("INTERVAL 1 HOUR"))
    return at.join(later, ["grid_id", "label_timestamp"])


def features_whole_history(fact: DataFrame) -> DataFrame:
    """One row per cell over its whole history; growth is the last date's mean against the first's."""
    rows = fact.withColumn("date", F.to_date("timestamp"))
    ends = rows.groupBy("grid_id").agg(F.min("date").alias("first"), F.max("date").alias("last"))
    rows = rows.join(ends, "grid_id")
    x = F.col("total_activity")
    on = lambda end: mean(F.when(F.col("date") == F.col(end), x))
    out = rows.groupBy("grid_id").agg(
        mean(x).alias("avg_activity"), on("first").alias("a"), on("last").alias("b"), F.count_if(x > 0).cast("int").alias("active_hours"), F.max(x).alias("top"), F.count("*").alias("n"),
        F.sum(x).alias("s"), F.sum(square(rows, "total_activity")).alias("q"), F.sum("internet_activity").alias("net"),
    )
    std = F.sqrt(pop_variance(F.col("n"), F.col("s"), F.col("q")))
    return out.select(
        "grid_id", "avg_activity", ratio(F.col("b") - F.col("a"), F.col("a")).alias("activity_growth"), "active_hours", ratio(F.col("top"), F.col("avg_activity")).alias("peak_ratio"),
        ratio(std, F.col("avg_activity")).alias("variability"), ratio(F.col("net"), F.col("s")).alias("internet_share"), F.col("n").cast("int").alias("row_count"),
        F.when(F.col("n") >= WINDOW_HOURS, "ok").otherwise("insufficient_data").alias("data_quality_status"),
    )


def leakage_violations(fact: DataFrame, frame: WindowSpec | None = None, hours: int = WINDOW_HOURS) -> DataFrame:
    """One row: how many feature rows a frame feeds with hours later than their own, or earlier than it should reach."""
    rows = fact.select("grid_id", "timestamp", F.unix_timestamp("timestamp").alias("epoch"))
    w = frame or trailing(hours)
    rows = rows.select("epoch", F.max("epoch").over(w).alias("latest"), F.min("epoch").over(w).alias("earliest"))
    return rows.agg(
        F.count("*").alias("rows"), F.count_if(F.col("latest") > F.col("epoch")).alias("later_rows"), F.count_if(F.col("earliest") < F.col("epoch") - (hours - 1) * _HOUR).alias("too_early_rows")
    )


def leakage_by_change(fact: DataFrame, build: Callable[[DataFrame], DataFrame], instant, time: str = "feature_timestamp") -> DataFrame:
    """One row ``(rows, changed)``: feature rows up to an instant, and how many of them differ once all later activity is changed.

    It asks nothing of how ``build(fact)`` makes its features, so it finds windows, joins or totals over data that a row couldn't know yet.
    """
    at = F.lit(instant).cast("timestamp")
    later = {c: F.when(F.col("timestamp") > at, F.coalesce(F.col(c), F.lit(0)) * 3 + 17).otherwise(F.col(c)).cast(fact.schema[c].dataType) for c in ("total_activity", "internet_activity")}
    keys = ["grid_id", time]

    def seen(df: DataFrame) -> DataFrame:
        own = build(df)
        rest = [c for c in own.columns if c not in keys]
        return own.where(F.col(time) <= at).select(*keys, F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}).alias("told"))

    a, b = seen(fact), seen(fact.withColumns(later)).withColumnRenamed("told", "then")
    return a.join(b, keys, "full").agg(F.count("*").alias("rows"), F.count_if(~F.col("told").eqNullSafe(F.col("then"))).alias("changed"))


def feature_array() -> Column:
    return F.array(*(F.col(f).cast("double") for f in FEATURES))
