"""Evidence packages: nested rows per cell that gather what is stored about it."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from cellwatch.functions.expressions import MEASURES, TOTALS, WINDOW_HOURS, mean
from cellwatch.operators.baselines import Instant, as_of_row, at_as_of
from cellwatch.operators.serving import grid_location, network_summary
from cellwatch.operators.signals import hotspots

NOTE = "Alerts, anomalies and risk scores are prompts to investigate; they don't prove a fault."


def recent_history(fact: DataFrame, at: Instant = None, n: int = WINDOW_HOURS) -> DataFrame:
    """Count, mean, least and largest activity of each cell's last n observed hours strictly before an instant."""
    rows = at_as_of(fact.select("grid_id", "timestamp", "total_activity"), at, F.col("timestamp") < F.col("as_of"))
    rows = rows.withColumn("k", F.row_number().over(Window.partitionBy("grid_id").orderBy(F.desc("timestamp")))).where(F.col("k") <= n)
    x = "total_activity"
    return rows.groupBy("grid_id").agg(F.count("*").alias("intervals"), mean(x).alias("mean_activity"), F.min(x).alias("min_activity"), F.max(x).alias("max_activity"))


def historical_evidence(fact: DataFrame, anomalies: DataFrame, risk: DataFrame, at: Instant = None) -> DataFrame:
    """What is known of each cell strictly before an instant: activity, anomaly and risk counts, and which of them there are."""
    instant = at if at is not None else None
    frame = as_of_row(fact, instant)
    before = lambda df: df.join(F.broadcast(frame), F.col("timestamp") < F.col("as_of"))  # noqa: E731  one row
    x = "total_activity"
    told = before(fact).groupBy("grid_id").agg(F.count("*").alias("activity_rows"), mean(x).alias("mean_activity"), F.min(x).alias("min_activity"), F.max(x).alias("max_activity"))
    is_ = lambda c, v: F.count_if(F.col(c) == v)
    odd = before(anomalies).groupBy("grid_id").agg(F.count("*").alias("scored"), F.count_if(F.col("is_anomaly")).alias("anomalies"), *(F.count_if(F.col("is_anomaly") & (F.col("direction") == d)).alias(f"{d}_anomalies") for d in ("high", "low")))
    level = before(risk).groupBy("grid_id").agg(*(is_("risk_level", v).alias(f"{v}_risks") for v in ("high", "medium", "low")))
    out = fact.select("grid_id").distinct().join(told, "grid_id", "left").join(odd, "grid_id", "left").join(level, "grid_id", "left")
    counts = ["activity_rows", "scored", "anomalies", "high_anomalies", "low_anomalies", "high_risks", "medium_risks", "low_risks"]
    out = out.withColumns({c: F.coalesce(c, F.lit(0)) for c in counts})
    return out.withColumns({
        "activity_available": F.col("activity_rows") > 0,
        "anomaly_available": F.col("scored") > 0,  # scored at all, anomaly or not
        "risk_available": F.col("high_risks") + F.col("medium_risks") + F.col("low_risks") > 0,
    }).drop("scored")


def _packed(df: DataFrame, name: str, drop: tuple[str, ...] = ("grid_id",)) -> DataFrame:
    return df.select("grid_id", F.struct(*(c for c in df.columns if c not in drop)).alias(name))


def grid_evidence(features: DataFrame, anomalies: DataFrame, alerts: DataFrame, risk: DataFrame | None = None) -> DataFrame:
    """One package per cell with features: latest features, anomaly, alerts (array), risk (or null) and what is missing.

    A cell has few alerts at an instant, so their array is small.
    """
    last = features.groupBy("grid_id").agg(F.max_by(F.struct(*(c for c in features.columns if c != "grid_id")), "feature_timestamp").alias("features"))
    told = alerts.groupBy("grid_id").agg(F.sort_array(F.collect_list(F.struct(*(c for c in alerts.columns if c != "grid_id")))).alias("alerts"))
    out = last.join(_packed(anomalies, "anomaly"), "grid_id", "left").join(told, "grid_id", "left")
    if risk is not None:
        out = out.join(_packed(risk, "risk"), "grid_id", "left")
    else:
        out = out.withColumn("risk", F.lit(None).cast("struct<risk_score:double,risk_level:string>"))
    lacks = F.array_compact(F.array(F.when(F.col("anomaly").isNull(), "anomaly"), F.when(F.col("alerts").isNull(), "alerts"), F.when(F.col("risk").isNull(), "risk")))
    empty = F.array().cast(out.schema["alerts"].dataType)
    return out.withColumn("missing", lacks).withColumn("alerts", F.coalesce("alerts", empty)).withColumn("note", F.lit(NOTE))


def _latest_run(health: DataFrame) -> DataFrame:
    """One row: the state of the latest run, by its time where that is told, else by its id."""
    order = [F.desc(c) for c in ("run_timestamp", "run_id") if c in health.columns]
    return health.orderBy(*order).select(F.struct(*health.columns).alias("pipeline")).limit(1)


def incident_context(evidence: DataFrame, recent: DataFrame, history: DataFrame, health: DataFrame) -> DataFrame:
    """Curated context of each cell: evidence, recent and historical summaries and the pipeline's state, nested and as JSON."""
    status = _latest_run(health)
    out = evidence.select("grid_id", F.struct(*(c for c in evidence.columns if c != "grid_id")).alias("evidence"))
    out = out.join(_packed(recent, "recent"), "grid_id", "left").join(_packed(history, "history"), "grid_id", "left")
    out = out.crossJoin(F.broadcast(status))  # one row
    packed = F.struct("evidence", "recent", "history", "pipeline", F.lit(NOTE).alias("note"))
    return out.select("grid_id", packed.alias("context"), F.to_json(packed).alias("context_json"))


def incident_context_full(evidence: DataFrame, fact: DataFrame, dim_grid: DataFrame, health: DataFrame, as_of: Instant = None) -> DataFrame:
    """Verbose context of each cell: state, summary, the 24-hour series, location, the hotspots of the network and evidence."""
    span = F.col("timestamp").between(F.col("as_of") - F.expr(f"INTERVAL {WINDOW_HOURS - 1} HOURS"), F.col("as_of"))
    series = at_as_of(fact, as_of, span).groupBy("grid_id").agg(F.sort_array(F.collect_list(F.struct("timestamp", *MEASURES, *TOTALS))).alias("series"))
    spots = hotspots(fact, as_of, 100).agg(F.sort_array(F.collect_list(F.struct("rank", "grid_id", "total_activity"))).alias("hotspots"))
    summary = network_summary(fact, as_of)
    shared = spots.crossJoin(summary.select(F.struct(*summary.columns).alias("summary"))).crossJoin(_latest_run(health))  # one row each
    out = evidence.select("grid_id", F.struct(*(c for c in evidence.columns if c != "grid_id")).alias("evidence"))
    out = out.join(series, "grid_id", "left").join(_packed(grid_location(dim_grid), "location"), "grid_id", "left").crossJoin(F.broadcast(shared))
    packed = F.struct("pipeline", "summary", "series", "location", "hotspots", "evidence")
    return out.select("grid_id", packed.alias("context"), F.to_json(packed).alias("context_json"))


def context_sizes(full: DataFrame, curated: DataFrame) -> DataFrame:
    """Characters of both contexts of a cell, and what the curated one saves."""
    a = full.select("grid_id", F.length("context_json").alias("full_chars"))
    b = curated.select("grid_id", F.length("context_json").alias("curated_chars"))
    return a.join(b, "grid_id").withColumn("saved", 1 - F.col("curated_chars") / F.col("full_chars"))
