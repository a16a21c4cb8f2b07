"""Checks of a run: rules over its tables, its status record, and the pipeline's health."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from cellwatch.operators.aggregate import duplicate_grain


def quality_check(fact: DataFrame, features: DataFrame, risk: DataFrame, anomalies: DataFrame) -> DataFrame:
    """One row of counts, and the rules that they break."""
    last = features.agg(F.count("*").alias("feature_rows"), F.max("feature_timestamp").alias("latest_feature"))
    at_last = risk.join(F.broadcast(last.select("latest_feature")), F.col("timestamp") == F.col("latest_feature")).agg(F.count("*").alias("risk_rows"))  # one row
    out = (
        fact.agg(F.count("*").alias("fact_rows"))
        .crossJoin(duplicate_grain(fact).agg(F.count("*").alias("duplicate_grain_groups")))
        .crossJoin(last)
        .crossJoin(at_last)
        .crossJoin(duplicate_grain(risk).agg(F.count("*").alias("duplicate_risk_groups")))
        .crossJoin(risk.agg(F.count_if(F.coalesce(F.trim("model_version"), F.lit("")) == "").alias("blank_versions")))
        .crossJoin(anomalies.agg(F.count("*").alias("anomaly_rows")))
    )  # one row each
    rules = {
        "fact has rows": F.col("fact_rows") > 0,
        "fact grain is unique": F.col("duplicate_grain_groups") == 0,
        "features have rows": F.col("feature_rows") > 0,
        "latest feature time is known": F.col("latest_feature").isNotNull(),
        "risk covers the latest features": F.col("risk_rows") > 0,
        "risk grain is unique": F.col("duplicate_risk_groups") == 0,
        "every risk row names its model": F.col("blank_versions") == 0,
        "anomalies have rows": F.col("anomaly_rows") > 0,
    }
    failed = F.array_compact(F.array(*(F.when(~ok, name) for name, ok in rules.items())))
    return out.withColumn("failed_rules", failed).withColumn("passed", F.size("failed_rules") == 0)


def status_record(check: DataFrame, run_id: str, metrics: DataFrame, published: DataFrame, tasks: dict[str, str]) -> DataFrame:
    """One row about a run: the state of its tasks, row counts and as-of instant."""
    states = F.create_map(*(F.lit(x) for pair in tasks.items() for x in pair)).cast("map<string,string>")
    verdict = F.create_map(F.lit("quality_check"), F.when(F.col("passed"), "success").otherwise("failed"))
    rows = check.crossJoin(metrics.select("input_rows", "rejected_ids", "rejected_negative", "nulls_handled")).crossJoin(published.select("rows_published", "warehouse_rows", "as_of"))
    return rows.select(
        F.lit(run_id).alias("run_id"), F.current_timestamp().alias("run_timestamp"), F.map_concat(states, verdict).alias("per_task_status"), F.col("input_rows").alias("rows_in"),
        (F.col("rejected_ids") + F.col("rejected_negative")).alias("rows_rejected"), "nulls_handled", "rows_published", "warehouse_rows", "duplicate_grain_groups", "as_of",
    )


def pipeline_health(status: DataFrame, fact: DataFrame) -> DataFrame:
    """A verdict for each run record: the reasons against it, and hours between its as-of instant and the data's latest."""
    last = fact.agg(F.max("timestamp").alias("latest"))
    rows = status.crossJoin(F.broadcast(last))  # one row
    bad = F.map_filter("per_task_status", lambda k, v: F.coalesce(v, F.lit("")) != "success")
    tasks = F.transform(F.map_entries(bad), lambda e: F.concat(F.lit("task "), e["key"], F.lit(" is "), F.coalesce(e["value"], F.lit("unknown"))))
    told = F.array_compact(
        F.array(
            F.when(F.coalesce("rows_published", F.lit(0)) <= 0, "no rows were published"),
            F.when(F.col("as_of").isNull(), "the run names no as-of time"),
            F.when(F.col("latest").isNull(), "the fact is empty"),
            F.when(F.col("as_of") != F.col("latest"), "the as-of time is not the latest of the data"),
        )
    )
    hours = F.abs(F.unix_timestamp("latest") - F.unix_timestamp("as_of")) / 3600
    out = rows.withColumn("reasons", F.concat(F.coalesce(tasks, F.array().cast("array<string>")), told)).withColumn("freshness_hours", hours)
    return out.withColumn("healthy", F.size("reasons") == 0)
