"""Cleaning, profiling, aggregation and warehouse queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwatch.functions.expressions import MEASURES
from cellwatch.operators import aggregate as agg, clean as cl, profile as pr, warehouse as wh
from cellwatch.plans.common import MEAN, WITH, cleaned, d, hourly, plain, raw, t
from cellwatch.sources.gate import NAME_DATE, drop_processed, missing_dates

_M = ", ".join(MEASURES)
_D = d(*MEASURES)
_ROW = f"{t('timestamp')} AS timestamp, CAST(grid_id AS BIGINT) AS grid_id, CAST(country_code AS BIGINT) AS country_code"
_H = f"CAST(grid_id AS BIGINT) AS grid_id, {t('timestamp')} AS timestamp"
_TOT = d("total_sms", "total_calls", "total_activity")


def _early(df):
    return df.where(F.col("timestamp") < F.lit("2024-01-20").cast("timestamp"))


def _late(df):
    return df.where(F.col("timestamp") >= F.lit("2024-01-18").cast("timestamp"))


def _files(s, sf):
    """File names of the days in the data."""
    name = F.concat(F.lit("sms-call-internet-mi-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv"))
    return s.read.parquet(f"{sf}/events.parquet").select(name.alias("name")).distinct()


def _audit(s, sf):
    rows = _files(s, sf)
    return rows.select("name", F.when(F.regexp_extract("name", NAME_DATE, 1).cast("date") < F.lit("2024-01-15").cast("date"), "accepted").otherwise("rejected").alias("status"))


QUERIES = {
    "canonicalize": lambda s, sf: plain(cl.canonicalize(raw(s, sf))),
    "reject_missing_ids": lambda s, sf: plain(cl.reject_missing_ids(cl.canonicalize(raw(s, sf)))),
    "reject_negative": lambda s, sf: plain(cl.reject_negative(cl.canonicalize(raw(s, sf)))),
    "fill_measures": lambda s, sf: plain(cl.fill_measures(cl.canonicalize(raw(s, sf)))),
    "clean": lambda s, sf: plain(cleaned(s, sf)),
    "clean_metrics": lambda s, sf: plain(cl.clean_metrics(raw(s, sf))),
    "with_time_parts": lambda s, sf: plain(cl.with_time_parts(cleaned(s, sf).select("grid_id", "timestamp"))),
    "with_totals": lambda s, sf: plain(cl.with_totals(cleaned(s, sf)).select("grid_id", "timestamp", "total_sms", "total_calls", "total_activity")),
    "with_internet_share": lambda s, sf: plain(cl.with_internet_share(hourly(s, sf)).select("grid_id", "timestamp", "internet_share")),
    "reconcile": lambda s, sf: plain(cl.reconcile(cleaned(s, sf), hourly(s, sf), MEASURES)),
    "known_grids": lambda s, sf: plain(cl.known_grids(s.read.parquet(f"{sf}/events.parquet").select((F.col("user_id") - 2).cast("int").alias("grid_id")).distinct(), hourly(s, sf).select("grid_id").distinct())),
    "profile": lambda s, sf: plain(pr.profile(cl.canonicalize(raw(s, sf)))),
    "duplicate_rows": lambda s, sf: plain(pr.duplicate_rows(cleaned(s, sf).select("grid_id", "timestamp", "country_code"))),
    "cadence": lambda s, sf: plain(pr.cadence(cleaned(s, sf))),
    "busiest_hour": lambda s, sf: plain(pr.busiest(hourly(s, sf), "hour")),
    "busiest_grid": lambda s, sf: plain(pr.busiest(hourly(s, sf), "grid_id")),
    "ingest_report": lambda s, sf: plain(pr.ingest_report(cl.canonicalize(raw(s, sf)))),
    "country_fanout": lambda s, sf: plain(pr.country_fanout(cleaned(s, sf), ("grid_id", "timestamp"))),
    "hourly_grid_summary": lambda s, sf: plain(hourly(s, sf)),
    "duplicate_grain": lambda s, sf: plain(agg.duplicate_grain(cleaned(s, sf))),
    "daily_grid_summary": lambda s, sf: plain(agg.daily_grid_summary(hourly(s, sf))),
    "daily_kpis": lambda s, sf: plain(agg.daily_kpis(hourly(s, sf))),
    "grid_kpis": lambda s, sf: plain(agg.grid_kpis(hourly(s, sf))),
    "hour_profile": lambda s, sf: plain(agg.hour_profile(hourly(s, sf))),
    "dashboard_summary": lambda s, sf: plain(agg.dashboard_summary(hourly(s, sf))),
    "build_dim_time": lambda s, sf: plain(wh.build_dim_time(hourly(s, sf))),
    "build_fact": lambda s, sf: plain(wh.build_fact(hourly(s, sf))),
    "star": lambda s, sf: plain(wh.star(wh.build_fact(hourly(s, sf)), wh.build_dim_time(hourly(s, sf))).select("grid_id", "time_key", "total_activity", "timestamp", "date", "hour", "day_of_week")),
    "orphans": lambda s, sf: plain(wh.orphans(wh.build_fact(hourly(s, sf)), wh.build_dim_time(_early(hourly(s, sf))), "time_key")),
    "upsert": lambda s, sf: plain(wh.upsert(_early(hourly(s, sf)), _late(hourly(s, sf)).withColumn("total_activity", (F.col("total_activity") + 1).cast("decimal(18,2)"))).select("grid_id", "timestamp", "total_activity")),
    "publication_summary": lambda s, sf: plain(wh.publication_summary(_early(hourly(s, sf)), _late(hourly(s, sf)))),
    "ensure_columns": lambda s, sf: plain(wh.ensure_columns(hourly(s, sf).select("grid_id", "timestamp", "sms_in"), {"internet_activity": 0.0})),
    "drop_processed": lambda s, sf: plain(drop_processed(_files(s, sf), _audit(s, sf))),
    "missing_dates": lambda s, sf: plain(missing_dates(_files(s, sf), "2024-01-01", "2024-02-05")),
}

_KPI = f"CAST(sum(total_activity) AS DOUBLE) AS total_activity, {MEAN.format(x='total_activity')} AS mean_activity, CAST(max(total_activity) AS DOUBLE) AS max_activity"
_CANON = f"{_ROW}, {_D}"
_NAMES = "f AS (SELECT DISTINCT 'sms-call-internet-mi-' || strftime(ts, '%Y-%m-%d') || '.csv' AS name FROM events)"
_BUSY = "SELECT CAST(k AS BIGINT) AS {k}, CAST(s AS DOUBLE) AS total FROM (SELECT {k} AS k, sum(total_activity) AS s FROM h GROUP BY {k}) ORDER BY s DESC, k LIMIT 1"

ORACLES = {
    "canonicalize": f"{WITH} SELECT {_CANON} FROM canon",
    "reject_missing_ids": f"{WITH} SELECT {_CANON} FROM flagged WHERE NOT no_ids",
    "reject_negative": f"{WITH} SELECT {_CANON} FROM flagged WHERE NOT negative",
    "fill_measures": f"{WITH} SELECT {_ROW}, {', '.join(f'CAST(coalesce({m}, 0) AS DOUBLE) AS {m}' for m in MEASURES)} FROM canon",
    "clean": f"{WITH} SELECT {_CANON}, date FROM clean",
    "clean_metrics": f"""{WITH} SELECT count(*) AS input_rows, count(*) FILTER (WHERE no_ids) AS rejected_ids, count(*) FILTER (WHERE NOT no_ids AND negative) AS rejected_negative,
        CAST(sum(CASE WHEN NOT no_ids AND NOT negative THEN {' + '.join(f'CAST({m} IS NULL AS INTEGER)' for m in MEASURES)} END) AS BIGINT) AS nulls_handled,
        count(*) FILTER (WHERE NOT no_ids AND NOT negative) AS output_rows, TRUE AS balanced FROM flagged""",
    "with_time_parts": f"{WITH} SELECT {_H}, date, hour(timestamp) AS hour, dayname(timestamp) AS day_of_week FROM clean",
    "with_totals": f"{WITH} SELECT {_H}, CAST(sms_in + sms_out AS DOUBLE) AS total_sms, CAST(call_in + call_out AS DOUBLE) AS total_calls, CAST(sms_in + sms_out + call_in + call_out + internet_activity AS DOUBLE) AS total_activity FROM clean",
    "with_internet_share": f"{WITH} SELECT {_H}, CASE WHEN total_activity > 0 THEN CAST(internet_activity AS DOUBLE) / CAST(total_activity AS DOUBLE) ELSE 0.0 END AS internet_share FROM h",
    "reconcile": f"{WITH} SELECT (SELECT count(*) FROM clean) AS rows_a, (SELECT count(*) FROM h) AS rows_b, 0.0::DOUBLE AS largest_difference, (SELECT count(*) FROM clean) = (SELECT count(*) FROM h) AS matches",
    "known_grids": f"{WITH} SELECT DISTINCT user_id - 2 AS grid_id FROM events WHERE user_id - 2 BETWEEN 1 AND 10000 AND user_id - 2 IN (SELECT grid_id FROM h)",
    "profile": f"""{WITH} SELECT count(*) AS rows, {', '.join(f'count(*) FILTER (WHERE {c} IS NULL) AS nulls_{c}' for c in ['timestamp', 'grid_id', 'country_code', *MEASURES])},
        {', '.join(f'count(*) FILTER (WHERE {m} < 0) AS negative_{m}' for m in MEASURES)}, count(DISTINCT grid_id) AS grids, count(DISTINCT country_code) AS countries,
        {t('min(timestamp)')} AS first_time, {t('max(timestamp)')} AS last_time FROM canon""",
    "duplicate_rows": f"{WITH} SELECT CAST(sum(c - 1) AS BIGINT) AS duplicate_rows FROM (SELECT count(*) AS c FROM clean GROUP BY grid_id, timestamp, country_code)",
    "cadence": f"""{WITH} SELECT *, unaligned_rows = 0 AND hours = expected_hours AS hourly FROM (SELECT count(DISTINCT timestamp) AS hours,
        count(*) FILTER (WHERE timestamp <> date_trunc('hour', timestamp)) AS unaligned_rows, date_diff('hour', min(timestamp), max(timestamp)) + 1 AS expected_hours FROM clean)""",
    "busiest_hour": f"{WITH} {_BUSY.format(k='hour')}",
    "busiest_grid": f"{WITH} {_BUSY.format(k='grid_id')}",
    "ingest_report": f"""{WITH} SELECT count(*) AS rows, CAST(1 AS BIGINT) AS files, count(DISTINCT grid_id) AS grids, count(DISTINCT country_code) AS countries, count(DISTINCT timestamp) AS intervals,
        CAST(min(grid_id) AS BIGINT) AS least_grid, CAST(max(grid_id) AS BIGINT) AS largest_grid, TRUE AS ids_in_range FROM canon""",
    "country_fanout": f"{WITH} SELECT {_H}, count(DISTINCT country_code) AS countries, count(*) AS rows FROM clean GROUP BY grid_id, clean.timestamp",
    "hourly_grid_summary": f"{WITH} SELECT {_H}, {_D}, {_TOT}, date, hour FROM h",
    "duplicate_grain": f"{WITH} SELECT {_H}, count(*) AS rows FROM clean GROUP BY grid_id, clean.timestamp HAVING count(*) > 1",
    "daily_grid_summary": f"{WITH} SELECT CAST(grid_id AS BIGINT) AS grid_id, date, CAST(sum(total_activity) AS DOUBLE) AS daily_total_activity FROM h GROUP BY ALL",
    "daily_kpis": f"{WITH} SELECT date, {_KPI} FROM h GROUP BY date",
    "grid_kpis": f"{WITH} SELECT CAST(grid_id AS BIGINT) AS grid_id, {_KPI} FROM h GROUP BY grid_id",
    "hour_profile": f"{WITH} SELECT hour, CAST(sum(total_activity) AS DOUBLE) AS total_activity FROM h GROUP BY hour",
    "dashboard_summary": f"{WITH} SELECT date, CAST(sum(total_activity) AS DOUBLE) AS daily_total_activity FROM h GROUP BY date",
    "build_dim_time": f"{WITH} SELECT DISTINCT CAST(strftime(h.timestamp, '%Y%m%d%H') AS BIGINT) AS time_key, {t('h.timestamp')} AS timestamp, date, hour, dayname(h.timestamp) AS day_of_week FROM h",
    "build_fact": f"{WITH} SELECT CAST(grid_id AS BIGINT) AS grid_id, CAST(strftime(h.timestamp, '%Y%m%d%H') AS BIGINT) AS time_key, {t('h.timestamp')} AS timestamp, {_D}, {_TOT} FROM h",
    "star": f"{WITH} SELECT CAST(grid_id AS BIGINT) AS grid_id, CAST(strftime(h.timestamp, '%Y%m%d%H') AS BIGINT) AS time_key, {d('total_activity')}, {t('h.timestamp')} AS timestamp, date, hour, dayname(h.timestamp) AS day_of_week FROM h",
    "orphans": f"{WITH} SELECT DISTINCT CAST(strftime(timestamp, '%Y%m%d%H') AS BIGINT) AS time_key FROM h WHERE timestamp >= '2024-01-20'",
    "upsert": f"{WITH} SELECT {_H}, CAST(total_activity + (CASE WHEN h.timestamp >= '2024-01-18' THEN 1 ELSE 0 END) AS DOUBLE) AS total_activity FROM h",
    "publication_summary": f"""{WITH} SELECT (SELECT count(*) FROM h WHERE timestamp >= '2024-01-18') AS rows_in, (SELECT count(*) FROM h WHERE timestamp >= '2024-01-18') AS rows_published,
        count(*) AS warehouse_rows, {t('max(timestamp)')} AS as_of FROM h""",
    "ensure_columns": f"{WITH} SELECT {_H}, {d('sms_in')}, 0.0::DOUBLE AS internet_activity FROM h",
    "drop_processed": f"WITH {_NAMES} SELECT name FROM f WHERE name >= 'sms-call-internet-mi-2024-01-15.csv'",
    "missing_dates": f"WITH {_NAMES} SELECT strftime(x, '%Y-%m-%d') AS date FROM (SELECT unnest(generate_series(TIMESTAMP '2024-01-01', TIMESTAMP '2024-02-05', INTERVAL 1 DAY)) AS x) WHERE 'sms-call-internet-mi-' || strftime(x, '%Y-%m-%d') || '.csv' NOT IN (SELECT name FROM f)",
}
