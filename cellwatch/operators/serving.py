"""Parameterised reads: summaries, series, stored features and anomalies."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from cellwatch.functions.expressions import WINDOW_HOURS
from cellwatch.operators.baselines import Instant, as_of_row, at_as_of
from cellwatch.operators.profile import busiest
from cellwatch.operators.segments import expanding_sums


def network_summary(fact: DataFrame, as_of: Instant = None) -> DataFrame:
    """One row for all hours up to as_of: total activity, cells ever active, busiest hour of the day, busiest cell."""
    rows = at_as_of(fact.select("grid_id", "timestamp", "total_activity"), as_of, F.col("timestamp") <= F.col("as_of"))
    cells = rows.groupBy("grid_id", F.hour("timestamp").alias("hour")).agg(
        F.sum("total_activity").alias("total_activity"), F.max(F.col("total_activity") > 0).alias("active"), F.max("as_of").alias("as_of")
    )  # at most 24 rows a cell from here on
    total = cells.agg(F.max("as_of").alias("as_of"), F.sum("total_activity").alias("total_activity"), F.countDistinct(F.when(F.col("active"), F.col("grid_id"))).alias("active_grids"))
    hour = busiest(cells, "hour").select(F.col("hour").alias("peak_hour"), F.col("total").alias("peak_hour_activity"))
    grid = busiest(cells, "grid_id").select(F.col("grid_id").alias("top_grid"), F.col("total").alias("top_grid_activity"))
    return total.crossJoin(hour).crossJoin(grid)  # one row each


def network_history(fact: DataFrame) -> DataFrame:
    """``network_summary`` for every hour of the data at once, ``(as_of, total_activity, active_grids, peak_hour, peak_hour_activity, top_grid, top_grid_activity)``.

    Activity is never negative, so a cell's sums only grow, and the busiest cell is the running maximum of all cells' sums; a cell counts as active
    from its first activity on; hours of the day are summed by date. Windows that see all dates or hours hold one row for each.
    """
    x = F.col("total_activity")
    rows = fact.select("grid_id", "timestamp", "total_activity")
    sums = expanding_sums(rows, {"before": F.coalesce(x, F.lit(0).cast(rows.schema["total_activity"].dataType))}).withColumn("sum", F.col("before") + x)
    hours = sums.groupBy("timestamp").agg(F.sum(x).alias("x"), F.max(F.struct("sum", (-F.col("grid_id")).alias("g"))).alias("top"))
    first = rows.where(x > 0).groupBy("grid_id").agg(F.min("timestamp").alias("timestamp")).groupBy("timestamp").agg(F.count("*").alias("new"))
    upto = Window.orderBy("timestamp").rowsBetween(Window.unboundedPreceding, 0)
    hours = hours.join(first, "timestamp", "left").select(
        "timestamp", F.sum("x").over(upto).alias("total_activity"), F.coalesce(F.sum("new").over(upto), F.lit(0)).alias("active_grids"), F.max("top").over(upto).alias("top")
    )
    hour = F.hour("timestamp")
    days = rows.groupBy(F.to_date("timestamp").alias("date")).agg(*(F.sum(F.when(hour == h, x)).alias(f"h{h}") for h in range(24)))
    earlier = Window.orderBy("date").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select("date", F.array(*(F.col(f"h{h}") for h in range(24))).alias("own"), F.array(*(F.sum(f"h{h}").over(earlier) for h in range(24))).alias("past"))
    at = hours.withColumn("date", F.to_date("timestamp")).join(days, "date")
    each = F.expr("transform(past, (p, h) -> struct(CASE WHEN h <= hour(timestamp) AND own[h] IS NOT NULL THEN coalesce(p, 0) + own[h] ELSE p END AS s, -h AS h))")
    at = at.withColumn("peak", F.array_max(F.filter(each, lambda e: e["s"].isNotNull())))
    return at.select(
        F.col("timestamp").alias("as_of"), "total_activity", "active_grids", (-F.col("peak.h")).alias("peak_hour"), F.col("peak.s").alias("peak_hour_activity"), (-F.col("top.g")).alias("top_grid"), F.col("top.sum").alias("top_grid_activity")
    )


def grid_activity(fact: DataFrame, grid_id: int, date: str | None = None, hour: int | None = None, as_of: Instant = None) -> DataFrame:
    """A cell's series up to as_of: of a date, of an hour of the day, of both, or of the last 24 hours."""
    rows = fact.where(F.col("grid_id") == grid_id)
    instant = as_of_row(fact, as_of)
    rows = rows.join(F.broadcast(instant), F.col("timestamp") <= F.col("as_of"))  # one row
    if date is not None:
        rows = rows.where(F.col("timestamp").between(F.to_timestamp(F.lit(f"{date} 00:00:00")), F.to_timestamp(F.lit(f"{date} 23:59:59"))))
    if hour is not None:
        rows = rows.where(F.hour("timestamp") == hour)
    if date is None and hour is None:
        rows = rows.where(F.col("timestamp") >= F.col("as_of") - F.expr(f"INTERVAL {WINDOW_HOURS - 1} HOURS"))
    return rows.drop("as_of").orderBy("timestamp")


def serve_features(grid_features: DataFrame, fact: DataFrame, grid_id: int | None = None, as_of: Instant = None) -> DataFrame:
    """Stored features as they are, with their age in hours; for a single cell a missing row is an error."""
    rows = grid_features
    if grid_id is not None:
        rows = rows.where(F.col("grid_id") == grid_id)
        if rows.isEmpty():
            raise LookupError(f"no features for grid_id {grid_id}")
    age = (F.unix_timestamp("as_of") - F.unix_timestamp("feature_timestamp")) / 3600
    return rows.crossJoin(F.broadcast(as_of_row(fact, as_of))).withColumn("feature_age_hours", F.round(age, 2))  # one row


def grid_location(dim_grid: DataFrame, grid_id: int | None = None) -> DataFrame:
    """Centroid and a reference text, without the polygon."""
    rows = dim_grid if grid_id is None else dim_grid.where(F.col("grid_id") == grid_id)
    told = F.format_string("Cell %d near %.5f, %.5f", F.col("grid_id").cast("int"), "centroid_lat", "centroid_lon")
    return rows.select("grid_id", "centroid_lat", "centroid_lon", told.alias("reference"))


def anomaly_lookup(requests: DataFrame, scores: DataFrame) -> DataFrame:
    """Stored anomaly of each requested cell and time; ``available`` is false where there is none."""
    keep = [c for c in scores.columns if c not in ("grid_id", "timestamp")]
    found = scores.select("grid_id", "timestamp", *keep, F.lit(True).alias("found"))
    out = requests.select("grid_id", "timestamp").join(found, ["grid_id", "timestamp"], "left")
    return out.select("grid_id", "timestamp", F.coalesce("found", F.lit(False)).alias("available"), *keep)


def missing_sections(df: DataFrame, text: str, sections: list[str]) -> DataFrame:
    """The required sections that each text lacks; a null text lacks all."""
    told = reduce(lambda a, b: a + b, ([F.when(~F.coalesce(F.contains(F.col(text), F.lit(s)), F.lit(False)), s)] for s in sections), [])
    return df.withColumn("missing", F.array_compact(F.array(*told)))
