"""Baselines from stored sums: one row for a cell, an hour of the day and a period, so that an instant costs its own period's rows and not all history."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellwatch.functions.expressions import pop_variance, square
from cellwatch.operators.baselines import Instant, as_of_row
from cellwatch.sources.versions import VersionedTable

#: Days of a period. Longer ones store less, and leave more rows of the fact to be read for an instant.
PERIOD_DAYS = 28


def period_of(time: Column | str) -> Column:
    return F.floor(F.datediff(F.to_date(time), F.lit("1970-01-01").cast("date")) / PERIOD_DAYS)


def _sums(rows: DataFrame, *by: Column | str) -> DataFrame:
    return rows.groupBy(*by).agg(F.count("x").alias("n"), F.sum("x").alias("s"), F.sum(square(rows, "x")).alias("q"))


def statistics(fact: DataFrame, measure: str = "total_activity") -> DataFrame:
    """``(period, grid_id, hour, n, s, q)``: count, sum and sum of squares, exact for decimals."""
    return _sums(fact.select("grid_id", "timestamp", F.col(measure).alias("x")), period_of("timestamp").alias("period"), "grid_id", F.hour("timestamp").alias("hour"))


def update_statistics(spark: SparkSession, path: str, fact: DataFrame, changed: DataFrame | None = None, measure: str = "total_activity") -> int:
    """Commit the sums of the periods that have rows in ``changed(timestamp)``, by default of all, made anew from ``fact``.

    Late corrections are rows of ``changed`` like any others: once they are in the fact, their periods' sums replace the stored ones. Doing it again
    changes nothing.
    """
    table = VersionedTable(spark, path, ("period",))
    if changed is not None:
        periods = changed.select(period_of("timestamp").alias("period")).distinct()
        fact = fact.withColumn("period", period_of("timestamp")).join(periods, "period", "left_semi").drop("period")
    return table.commit(statistics(fact, measure), keep_others=changed is not None)


def baselines_from(stored: DataFrame, fact: DataFrame, as_of: Instant = None, bucket: str = "all_history", measure: str = "total_activity") -> DataFrame:
    """What ``baselines`` gives, from the stored sums of whole periods before as_of and the fact's rows since."""
    if bucket not in ("all_history", "hour_of_day"):
        raise ValueError(f"unknown bucket {bucket}")
    instant = F.broadcast(as_of_row(fact, as_of))  # one row
    same = F.lit(True) if bucket == "all_history" else F.col("hour") == F.hour("as_of")
    whole = stored.join(instant, (F.col("period") < period_of("as_of")) & same)
    rows = fact.select("grid_id", "timestamp", F.hour("timestamp").alias("hour"), F.col(measure).alias("x")).join(instant, (period_of("timestamp") == period_of("as_of")) & (F.col("timestamp") < F.col("as_of")) & same)
    parts = whole.select("grid_id", "n", "s", "q").unionByName(_sums(rows, "grid_id"))
    kinds = {c: stored.schema[c].dataType for c in "sq"}
    out = parts.groupBy("grid_id").agg(F.sum("n").alias("n"), *(F.sum(c).cast(kinds[c]).alias(c) for c in "sq"))
    n = F.nullif(F.col("n"), F.lit(0))
    return out.select(
        "grid_id", "n", (F.col("s").cast("double") / n).alias("baseline"), (F.col("q").cast("double") / n).alias("mean_square"), F.sqrt(pop_variance(F.col("n"), F.col("s"), F.col("q"))).alias("std")
    )
