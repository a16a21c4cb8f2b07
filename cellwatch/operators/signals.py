"""Hotspots, rule alerts, anomalies and reports. They are prompts to investigate, never proof of a fault."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from cellwatch.functions.expressions import ANOMALY_MIN_SAMPLES, ANOMALY_Z, DROP_RATIO, FLOOR_PERCENTILE, HIGH_RATIO, SEVERITY_HIGH, SEVERITY_MEDIUM, SPIKE_RATIO, risk_level
from cellwatch.operators.baselines import Instant, baselines, snapshot, within_day_baseline
from cellwatch.operators.percentiles import exact_percentiles
from cellwatch.operators.segments import previous_value

MAX_ROWS = 1000


def _limit(n: int) -> int:
    if not 1 <= n <= MAX_ROWS:
        raise ValueError(f"n {n} is not within 1..{MAX_ROWS}")
    return n


def attach_risk(df: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """Risk score, level and version of the same cell and time, null where there is none or no table at all."""
    if risk is None:
        return df.withColumns({"risk_score": F.lit(None).cast("double"), "risk_level": F.lit(None).cast("string"), "model_version": F.lit(None).cast("string")})
    return df.join(risk.select("grid_id", "timestamp", "risk_score", "risk_level", "model_version"), ["grid_id", "timestamp"], "left")


def hotspots(fact: DataFrame, as_of: Instant = None, n: int = 20, status: str | None = None, risk: DataFrame | None = None) -> DataFrame:
    """The n busiest cells at as_of, ranked, by activity and then by cell. A status filter works on these n."""
    top = snapshot(fact, as_of).select("grid_id", "timestamp", "total_activity").orderBy(F.desc("total_activity"), "grid_id").limit(_limit(n))
    rank = F.row_number().over(Window.partitionBy("timestamp").orderBy(F.desc("total_activity"), "grid_id"))
    out = top.withColumns({"rank": rank, "status": F.lit("elevated")})
    out = out.withColumn("reason", F.format_string("Rank %d by total activity in this hour", "rank"))
    if status is not None:
        out = out.where(F.col("status") == status)
    return attach_risk(out, risk)


def score_join(current: DataFrame, base: DataFrame, measure: str = "total_activity", min_samples: int = 2) -> DataFrame:
    """Current activity against its baseline; cells with too few samples or without variation are left out."""
    usable = base.where((F.col("n") >= min_samples) & (F.col("std") > 0))
    out = current.join(usable, "grid_id").withColumn("current", F.col(measure).cast("double"))
    return out.withColumn("z_score", (F.col("current") - F.col("baseline")) / F.col("std"))


def severity(z: Column) -> Column:
    return F.when(z >= SEVERITY_HIGH, "high").when(z >= SEVERITY_MEDIUM, "medium")


def all_alerts(fact: DataFrame, as_of: Instant = None, base: DataFrame | None = None) -> DataFrame:
    """Cells at as_of whose z-score against all their earlier hours is medium or high; ``base`` may bring the baselines, as from stored sums."""
    base = baselines(fact, as_of) if base is None else base
    scored = score_join(snapshot(fact, as_of).select("grid_id", "timestamp", "total_activity"), base, min_samples=1)
    out = scored.withColumn("severity", severity(F.col("z_score"))).where("severity IS NOT NULL")
    told = F.format_string("Activity %.1f is %.1f standard deviations above the earlier mean of %.1f", "current", "z_score", "baseline")
    return out.select("grid_id", "timestamp", "current", "baseline", "std", "n", "z_score", "severity", told.alias("reason"))


def alerts(fact: DataFrame, as_of: Instant = None, n: int = 20, severity: str | None = None, risk: DataFrame | None = None) -> DataFrame:
    """The n largest alerts; a severity filter works before the limit."""
    found = all_alerts(fact, as_of)
    if severity is not None:
        found = found.where(F.col("severity") == severity)
    return attach_risk(found.orderBy(F.desc("z_score"), "grid_id").limit(_limit(n)), risk)


def anomaly_scores(fact: DataFrame, as_of: Instant = None, base: DataFrame | None = None) -> DataFrame:
    """Every cell at as_of against the same hour of its earlier days; ``base`` may bring these baselines. The direction is the score's sign, whether or not the score is an anomaly."""
    base = baselines(fact, as_of, "hour_of_day") if base is None else base
    out = score_join(snapshot(fact, as_of).select("grid_id", "timestamp", "total_activity"), base, min_samples=ANOMALY_MIN_SAMPLES)
    z = F.col("z_score")
    odd = F.abs(z) >= ANOMALY_Z
    direction = F.when(z > 0, "high").when(z < 0, "low").otherwise("normal")
    told = F.format_string("Activity %.1f against a same-hour mean of %.1f (%.2f standard deviations)", "current", "baseline", "z_score")
    return out.select("grid_id", "timestamp", "current", "baseline", "std", "n", z.alias("anomaly_score"), direction.alias("direction"), odd.alias("is_anomaly"), told.alias("reason"))


def anomaly_summary(scores: DataFrame) -> DataFrame:
    """One row: scored cells, anomalies of each direction, and the range of baseline samples."""
    return scores.agg(
        F.count("*").alias("scored"), *(F.count_if(F.col("is_anomaly") & (F.col("direction") == d)).alias(d) for d in ("high", "low")),
        F.min("n").alias("least_samples"), F.max("n").alias("most_samples"),
    )


def anomaly_extremes(scores: DataFrame, n: int = 5) -> DataFrame:
    """The n strongest anomalies of each direction."""
    odd = scores.where("is_anomaly")
    sides = [odd.where(F.col("direction") == d).orderBy(F.desc(F.abs("anomaly_score")), "grid_id").limit(n) for d in ("high", "low")]
    return sides[0].unionByName(sides[1])


def activity_floor(hourly: DataFrame, share: float = FLOOR_PERCENTILE) -> DataFrame:
    """One row: the percentile of the cells' totals, linearly interpolated."""
    totals = hourly.groupBy("grid_id").agg(F.sum("total_activity").cast("double").alias("total"))
    return exact_percentiles(totals, ["total"], share).withColumnRenamed("total", "floor")


def within_day_alerts(hourly: DataFrame) -> DataFrame:
    """Rule alerts of each hour against the median of its day's other hours and the row before; cells below the floor are left out.

    A row may raise several. The row before is the cell's last observed hour, across gaps and midnight.
    """
    hourly = hourly.select("grid_id", "timestamp", "date", "total_activity")
    totals = hourly.groupBy("grid_id").agg(F.sum("total_activity").cast("double").alias("total"))
    floor = exact_percentiles(totals, ["total"], FLOOR_PERCENTILE).withColumnRenamed("total", "floor")
    busy = totals.join(F.broadcast(floor), F.col("total") >= F.col("floor")).select("grid_id")  # one row
    rows = within_day_baseline(hourly).withColumn("current", F.col("total_activity").cast("double"))
    rows = previous_value(rows, "current")
    rows = rows.join(busy, "grid_id", "left_semi").where("baseline > 0")
    x, base, last = F.col("current"), F.col("baseline"), F.col("previous")
    alert = lambda on, name, against: F.when(on, F.struct(F.lit(name).alias("alert_type"), against.alias("against")))
    told = F.array(
        alert(x > HIGH_RATIO * base, "HIGH_ACTIVITY", base),
        alert((last > 0) & (x > SPIKE_RATIO * last), "ACTIVITY_SPIKE", last),
        alert(x < DROP_RATIO * base, "ACTIVITY_DROP", base),
    )
    rows = rows.withColumn("a", F.explode(F.array_compact(told)))
    reason = F.format_string("%s: %.1f against %.1f", "a.alert_type", "current", "a.against")
    return rows.select("grid_id", "timestamp", "a.alert_type", "current", "baseline", reason.alias("reason"))


def alert_volume(alerts: DataFrame, hourly: DataFrame) -> DataFrame:
    """One row: alerts in all and by type, and their share of all cell-hours."""
    out = alerts.agg(
        F.count("*").alias("alerts"), *(F.count_if(F.col("alert_type") == t).alias(t.lower()) for t in ("HIGH_ACTIVITY", "ACTIVITY_SPIKE", "ACTIVITY_DROP"))
    ).crossJoin(hourly.agg(F.count("*").alias("grid_hours")))  # one row each
    return out.withColumn("share", F.col("alerts").cast("double") / F.nullif(F.col("grid_hours"), F.lit(0)))


def most_alerted(alerts: DataFrame, n: int = 10) -> DataFrame:
    return alerts.groupBy("grid_id").agg(F.count("*").alias("alerts")).orderBy(F.desc("alerts"), "grid_id").limit(n)


def top_grids(daily: DataFrame, date: str | None = None, n: int = 10) -> DataFrame:
    """The n busiest cells of a day, or of every day."""
    rows = daily if date is None else daily.where(F.col("date") == date)
    w = Window.partitionBy("date").orderBy(F.desc("daily_total_activity"), "grid_id")
    return rows.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def top_grids_geo(hourly: DataFrame, dim_grid: DataFrame, n: int = 10) -> DataFrame:
    """The n busiest cells with geometry and centroid; geometry is joined to the n rows only."""
    top = hourly.groupBy("grid_id").agg(F.sum("total_activity").alias("total_activity")).orderBy(F.desc("total_activity"), "grid_id").limit(n)
    return top.join(dim_grid.select("grid_id", "centroid_lat", "centroid_lon", "geometry_json"), "grid_id", "left")


def risk_level_counts(risk: DataFrame) -> DataFrame:
    return risk.groupBy("risk_level").agg(F.count("*").alias("grids"))


def attention_report(risk: DataFrame, timestamp: Instant = None, n: int = 20) -> DataFrame:
    """Cells to look at first: the n largest scores of a snapshot, by default the latest."""
    at = snapshot(risk, timestamp)
    out = at.orderBy(F.desc("risk_score"), "grid_id").limit(n)
    note = F.format_string("Needs attention: investigate cell %d, risk score %.3f", F.col("grid_id").cast("int"), "risk_score")
    return out.select("grid_id", "timestamp", "risk_score", risk_level(F.col("risk_score")).alias("risk_level"), note.alias("note"))
