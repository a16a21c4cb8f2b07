"""Queries on baselines, features, alerts, anomalies, serving reads and geometry."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwatch.adapters import cell_count, square_cells
from cellwatch.functions.expressions import risk_level
from cellwatch.operators import baselines as bl, evidence as ev, features as ft, geo, serving as sv, signals as sg
from cellwatch.plans.common import CELLS, AS_OF, MEAN, VAR, WITH, d, hourly, plain, t


#: An instant with alerts and anomalies at the small scales.
AT = "2024-01-20 13:00:00"


def _features(s, sf):
    return ft.build_features(hourly(s, sf))


def _alerts(s, sf):
    return sg.within_day_alerts(hourly(s, sf))


def _dim(s, sf):
    return geo.build_dim_grid(square_cells(s, cell_count(s, sf)))


def _all_but_last(s, sf):
    """Geometry that lacks a cell."""
    return square_cells(s, cell_count(s, sf) - 1)


def _with_one_astray(s, sf):
    """The dimension of the cells with events, the last of them far off."""
    there = _dim(s, sf).join(hourly(s, sf).select("grid_id").distinct(), "grid_id")
    return there.withColumn("centroid_lon", F.when(F.col("grid_id") == cell_count(s, sf), 9.9).otherwise(F.col("centroid_lon")))


def _stored(s, sf):
    """A risk table: one row per cell and hour, scored by the hour's share of internet."""
    h = hourly(s, sf)
    score = F.coalesce(F.col("internet_activity").cast("double") / F.nullif(F.col("total_activity").cast("double"), F.lit(0.0)), F.lit(0.0))
    return h.select("grid_id", "timestamp", score.alias("risk_score"), risk_level(score).alias("risk_level"), F.lit("share-1").alias("model_version"))


def _anomalies(s, sf):
    return sg.anomaly_scores(hourly(s, sf), AT)


def _requests(s, sf):
    return hourly(s, sf).select("grid_id", "timestamp")


def _sections(s, sf):
    docs = s.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    return sv.missing_sections(docs, "text", ["License", "the of", "\n"]).select("doc_id", "missing")


QUERIES = {
    "hotspots": lambda s, sf: plain(sg.hotspots(hourly(s, sf), n=3).drop("reason")),
    "hotspots_with_risk": lambda s, sf: plain(sg.hotspots(hourly(s, sf), as_of=AS_OF, n=3, status="elevated", risk=_stored(s, sf)).drop("reason")),
    "alerts": lambda s, sf: plain(sg.alerts(hourly(s, sf), AT, n=20).drop("reason")),
    "all_alerts": lambda s, sf: plain(sg.all_alerts(hourly(s, sf), as_of=AT).drop("reason")),
    "baselines": lambda s, sf: plain(bl.baselines(hourly(s, sf))),
    "baselines_hour_of_day": lambda s, sf: plain(bl.baselines(hourly(s, sf), AS_OF, "hour_of_day")),
    "expanding_zscores": lambda s, sf: plain(bl.expanding_zscores(hourly(s, sf))),
    "within_day_baseline": lambda s, sf: plain(bl.within_day_baseline(hourly(s, sf)).select("grid_id", "timestamp", "baseline")),
    "resolve_as_of": lambda s, sf: plain(bl.as_of_row(hourly(s, sf))),
    "score_join": lambda s, sf: plain(sg.score_join(bl.snapshot(hourly(s, sf)).select("grid_id", "timestamp", "total_activity"), bl.baselines(hourly(s, sf))).select("grid_id", "timestamp", "current", "z_score")),
    "anomaly_scores": lambda s, sf: plain(_anomalies(s, sf).drop("reason")),
    "anomaly_summary": lambda s, sf: plain(sg.anomaly_summary(_anomalies(s, sf))),
    "anomaly_extremes": lambda s, sf: plain(sg.anomaly_extremes(_anomalies(s, sf)).select("grid_id", "direction", "anomaly_score")),
    "activity_floor": lambda s, sf: plain(sg.activity_floor(hourly(s, sf)).select(F.round("floor", 9).alias("floor"))),
    "within_day_alerts": lambda s, sf: plain(_alerts(s, sf).drop("reason")),
    "alert_volume": lambda s, sf: plain(sg.alert_volume(_alerts(s, sf), hourly(s, sf))),
    "most_alerted": lambda s, sf: plain(sg.most_alerted(_alerts(s, sf))),
    "top_grids": lambda s, sf: plain(sg.top_grids(hourly(s, sf).groupBy("grid_id", "date").agg(F.sum("total_activity").alias("daily_total_activity")), n=2)),
    "top_grids_geo": lambda s, sf: plain(sg.top_grids_geo(hourly(s, sf), _dim(s, sf), n=3).select("grid_id", "total_activity", F.col("geometry_json").isNotNull().alias("has_geometry"))),
    "risk_level_counts": lambda s, sf: plain(sg.risk_level_counts(_stored(s, sf))),
    "attention_report": lambda s, sf: plain(sg.attention_report(_stored(s, sf), n=3).drop("note")),
    "attach_risk": lambda s, sf: plain(sg.attach_risk(hourly(s, sf).select("grid_id", "timestamp"), _stored(s, sf))),
    "build_features": lambda s, sf: plain(_features(s, sf)),
    "latest_per_grid": lambda s, sf: plain(ft.latest_per_grid(_features(s, sf))),
    "feature_summary": lambda s, sf: plain(ft.feature_summary(_features(s, sf))),
    "features_whole_history": lambda s, sf: plain(ft.features_whole_history(hourly(s, sf))),
    "next_hour_labels": lambda s, sf: plain(ft.next_hour_labels(_features(s, sf), hourly(s, sf)).select("grid_id", "feature_timestamp", "label_timestamp", "next_hour_activity")),
    "leakage_violations": lambda s, sf: plain(ft.leakage_violations(hourly(s, sf))),
    "network_summary": lambda s, sf: plain(sv.network_summary(hourly(s, sf))),
    "network_summary_as_of": lambda s, sf: plain(sv.network_summary(hourly(s, sf), AS_OF)),
    "grid_activity": lambda s, sf: plain(sv.grid_activity(hourly(s, sf), 2).select("grid_id", "timestamp", "total_activity")),
    "grid_activity_hour": lambda s, sf: plain(sv.grid_activity(hourly(s, sf), 2, hour=5, as_of=AS_OF).select("grid_id", "timestamp", "total_activity")),
    "serve_features": lambda s, sf: plain(sv.serve_features(ft.latest_per_grid(_features(s, sf)), hourly(s, sf)).select("grid_id", "feature_timestamp", "as_of", "feature_age_hours")),
    "anomaly_lookup": lambda s, sf: plain(sv.anomaly_lookup(_requests(s, sf), _anomalies(s, sf).select("grid_id", "timestamp", "direction"))),
    "missing_sections": lambda s, sf: plain(_sections(s, sf)),
    "recent_history": lambda s, sf: plain(ev.recent_history(hourly(s, sf))),
    "historical_evidence": lambda s, sf: plain(ev.historical_evidence(hourly(s, sf), _anomalies(s, sf), _stored(s, sf))),
    "enrich_geometry": lambda s, sf: plain(geo.enrich_geometry(hourly(s, sf), _all_but_last(s, sf)).select("grid_id", "timestamp", F.col("geometry_json").isNotNull().alias("has_geometry"))),
    "join_coverage": lambda s, sf: plain(geo.join_coverage(hourly(s, sf), _all_but_last(s, sf), "grid_id")),
    "unmatched_keys": lambda s, sf: plain(geo.unmatched_keys(hourly(s, sf), _all_but_last(s, sf), "grid_id")),
    "check_geometry_keys": lambda s, sf: plain(geo.check_geometry_keys(hourly(s, sf).select("grid_id").distinct(), 1, cell_count(s, sf))),
    "check_adjacency": lambda s, sf: plain(geo.check_adjacency(_with_one_astray(s, sf)).select("grid_id", "in_city")),
    "map_layer": lambda s, sf: plain(geo.map_layer(sg.hotspots(hourly(s, sf), n=3), sg.all_alerts(hourly(s, sf)), square_cells(s, cell_count(s, sf))).select("grid_id", "state")),
}

_G = "CAST(grid_id AS BIGINT) AS grid_id"
_H = f"{_G}, {t('timestamp')} AS timestamp"
_LAST = "(SELECT max(timestamp) FROM h)"
_BASE = "b AS (SELECT grid_id, count(*) AS n, {mean} AS baseline, CAST(sum(CAST(total_activity AS DECIMAL(18,2)) * CAST(total_activity AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_square, sqrt({var}) AS std FROM h WHERE {past} GROUP BY grid_id)"


def _base(past: str) -> str:
    return _BASE.format(mean=MEAN.format(x="total_activity"), var=VAR.format(x="total_activity"), past=past)


_Z = "z AS (SELECT h.grid_id, h.timestamp, CAST(h.total_activity AS DOUBLE) AS current, baseline, std, n, (CAST(h.total_activity AS DOUBLE) - baseline) / std AS z_score FROM h JOIN b USING (grid_id) WHERE std > 0 AND n >= {least} AND h.timestamp = {at})"
_SEV = "CASE WHEN z_score >= 3 THEN 'high' WHEN z_score >= 2 THEN 'medium' END"
_AT = f"TIMESTAMP '{AT}'"
_ANOM = f"{_base(f'timestamp < {_AT} AND hour = hour({_AT})')}, {_Z.format(least=2, at=_AT)}, a AS (SELECT *, z_score AS anomaly_score, CASE WHEN z_score > 0 THEN 'high' WHEN z_score < 0 THEN 'low' ELSE 'normal' END AS direction, abs(z_score) >= 2 AS is_anomaly FROM z)"
_FEAT = f"""w AS (SELECT grid_id, timestamp, count(*) OVER r AS n, sum(total_activity) OVER r AS s, sum(CAST(total_activity AS DECIMAL(18,2)) * total_activity) OVER r AS q, max(total_activity) OVER r AS top,
    count(*) FILTER (WHERE total_activity > 0) OVER r AS active, sum(internet_activity) OVER r AS net, count(*) OVER o AS n0, sum(total_activity) OVER o AS s0 FROM h
    WINDOW r AS (PARTITION BY grid_id ORDER BY timestamp RANGE BETWEEN INTERVAL 23 HOURS PRECEDING AND CURRENT ROW), o AS (PARTITION BY grid_id ORDER BY timestamp RANGE BETWEEN INTERVAL 47 HOURS PRECEDING AND INTERVAL 24 HOURS PRECEDING)),
  w2 AS (SELECT *, CAST(s AS DOUBLE) / n AS av, CAST(s0 AS DOUBLE) / nullif(n0, 0) AS ba, greatest(CAST(q * n - CAST(s AS DECIMAL(18,2)) * CAST(s AS DECIMAL(18,2)) AS DOUBLE) / CAST(n * n AS DOUBLE), 0.0) AS va FROM w),
  f AS (SELECT grid_id, timestamp AS feature_timestamp, av AS avg_activity, (av - ba) / nullif(ba, 0) AS activity_growth, active AS active_hours, CAST(top AS DOUBLE) / nullif(av, 0) AS peak_ratio, sqrt(va) / nullif(av, 0) AS variability,
    CAST(net AS DOUBLE) / nullif(CAST(s AS DOUBLE), 0) AS internet_share, CASE WHEN n >= 24 AND n0 >= 24 THEN 'ok' ELSE 'insufficient_data' END AS data_quality_status, n AS row_count FROM w2)"""
_FCOLS = f"{_G}, {t('feature_timestamp')} AS feature_timestamp, avg_activity, activity_growth, active_hours, peak_ratio, variability, internet_share, data_quality_status, row_count"
_DAY = """wd AS (SELECT grid_id, timestamp, CAST(total_activity AS DOUBLE) AS current, median(CAST(total_activity AS DOUBLE)) OVER (PARTITION BY grid_id, date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS baseline,
    lag(CAST(total_activity AS DOUBLE)) OVER (PARTITION BY grid_id ORDER BY timestamp) AS previous FROM h)"""
_ALERTS = f"""{_DAY}, tot AS (SELECT grid_id, CAST(sum(total_activity) AS DOUBLE) AS total FROM h GROUP BY grid_id), fl AS (SELECT quantile_cont(total, 0.1) AS floor FROM tot),
  ok AS (SELECT wd.* FROM wd JOIN tot USING (grid_id), fl WHERE total >= floor AND baseline > 0),
  al AS (SELECT grid_id, timestamp, 'HIGH_ACTIVITY' AS alert_type, current, baseline FROM ok WHERE current > 1.5 * baseline UNION ALL SELECT grid_id, timestamp, 'ACTIVITY_SPIKE', current, baseline FROM ok WHERE previous > 0 AND current > 1.5 * previous
    UNION ALL SELECT grid_id, timestamp, 'ACTIVITY_DROP', current, baseline FROM ok WHERE current < 0.5 * baseline)"""
_RISK = "k0 AS (SELECT grid_id, timestamp, coalesce(CAST(internet_activity AS DOUBLE) / nullif(CAST(total_activity AS DOUBLE), 0), 0.0) AS risk_score FROM h), k AS (SELECT *, CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level, 'share-1' AS model_version FROM k0)"
_HOT = "row_number() OVER (ORDER BY total_activity DESC, grid_id) AS rank, 'elevated' AS status"
_SUMM = """u AS (SELECT * FROM h WHERE timestamp <= {at}), hh AS (SELECT hour, sum(total_activity) AS s FROM u GROUP BY hour ORDER BY s DESC, hour LIMIT 1), gg AS (SELECT grid_id, sum(total_activity) AS s FROM u GROUP BY grid_id ORDER BY s DESC, grid_id LIMIT 1)
  SELECT {out} AS as_of, CAST(sum(total_activity) AS DOUBLE) AS total_activity, count(DISTINCT CASE WHEN total_activity > 0 THEN u.grid_id END) AS active_grids, (SELECT hour FROM hh) AS peak_hour, (SELECT CAST(s AS DOUBLE) FROM hh) AS peak_hour_activity,
    (SELECT CAST(grid_id AS BIGINT) FROM gg) AS top_grid, (SELECT CAST(s AS DOUBLE) FROM gg) AS top_grid_activity FROM u"""
_COUNT = lambda c, v, name: f"count(*) FILTER (WHERE {c} = '{v}') AS {name}"

ORACLES = {
    "hotspots": f"{WITH} SELECT {_H}, {d('total_activity')}, {_HOT}, CAST(NULL AS DOUBLE) AS risk_score, CAST(NULL AS VARCHAR) AS risk_level, CAST(NULL AS VARCHAR) AS model_version FROM h WHERE h.timestamp = {_LAST} ORDER BY rank LIMIT 3",
    "hotspots_with_risk": f"{WITH}, {_RISK} SELECT CAST(h.grid_id AS BIGINT) AS grid_id, {t('h.timestamp')} AS timestamp, {d('total_activity')}, row_number() OVER (ORDER BY total_activity DESC, h.grid_id) AS rank, 'elevated' AS status, risk_score, risk_level, model_version FROM h JOIN k USING (grid_id, timestamp) WHERE h.timestamp = '{AS_OF}' ORDER BY rank LIMIT 3",
    "alerts": f"{WITH}, {_base(f'timestamp < {_AT}')}, {_Z.format(least=1, at=_AT)} SELECT {_H}, current, baseline, std, n, z_score, {_SEV} AS severity, CAST(NULL AS DOUBLE) AS risk_score, CAST(NULL AS VARCHAR) AS risk_level, CAST(NULL AS VARCHAR) AS model_version FROM z WHERE z_score >= 2 ORDER BY z_score DESC, z.grid_id LIMIT 20",
    "all_alerts": f"{WITH}, {_base(f'timestamp < {_AT}')}, {_Z.format(least=1, at=_AT)} SELECT {_H}, current, baseline, std, n, z_score, {_SEV} AS severity FROM z WHERE z_score >= 2",
    "baselines": f"{WITH}, {_base(f'timestamp < {_LAST}')} SELECT {_G}, n, baseline, mean_square, std FROM b",
    "baselines_hour_of_day": f"""{WITH}, {_base(f"timestamp < '{AS_OF}' AND hour = 12")} SELECT {_G}, n, baseline, mean_square, std FROM b""",
    "expanding_zscores": f"""{WITH}, x AS (SELECT grid_id, timestamp, total_activity AS x, count(*) OVER w AS n, sum(total_activity) OVER w AS s, sum(CAST(total_activity AS DECIMAL(18,2)) * total_activity) OVER w AS q FROM h WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        y AS (SELECT *, CAST(q * n - CAST(s AS DECIMAL(18,2)) * CAST(s AS DECIMAL(18,2)) AS DOUBLE) / nullif(CAST(n * n AS DOUBLE), 0) AS va FROM x) SELECT {_H}, n, CASE WHEN va > 0 THEN (CAST(x AS DOUBLE) - CAST(s AS DOUBLE) / n) / sqrt(va) END AS z_score FROM y""",
    "within_day_baseline": f"{WITH}, {_DAY} SELECT {_H}, baseline FROM wd",
    "resolve_as_of": f"{WITH} SELECT {t('max(timestamp)')} AS as_of FROM h",
    "score_join": f"{WITH}, {_base(f'timestamp < {_LAST}')}, {_Z.format(least=2, at=_LAST)} SELECT {_H}, current, z_score FROM z",
    "anomaly_scores": f"{WITH}, {_ANOM} SELECT {_H}, current, baseline, std, n, anomaly_score, direction, is_anomaly FROM a",
    "anomaly_summary": f"{WITH}, {_ANOM} SELECT count(*) AS scored, count(*) FILTER (WHERE is_anomaly AND direction = 'high') AS high, count(*) FILTER (WHERE is_anomaly AND direction = 'low') AS low, min(n) AS least_samples, max(n) AS most_samples FROM a",
    "anomaly_extremes": f"{WITH}, {_ANOM} SELECT {_G}, direction, anomaly_score FROM (SELECT *, row_number() OVER (PARTITION BY direction ORDER BY abs(anomaly_score) DESC, grid_id) AS i FROM a WHERE is_anomaly) WHERE i <= 5",
    "activity_floor": f"{WITH} SELECT round(quantile_cont(total, 0.1), 9) AS floor FROM (SELECT CAST(sum(total_activity) AS DOUBLE) AS total FROM h GROUP BY grid_id)",
    "within_day_alerts": f"{WITH}, {_ALERTS} SELECT {_H}, alert_type, current, baseline FROM al",
    "alert_volume": f"{WITH}, {_ALERTS} SELECT count(*) AS alerts, {_COUNT('alert_type', 'HIGH_ACTIVITY', 'high_activity')}, {_COUNT('alert_type', 'ACTIVITY_SPIKE', 'activity_spike')}, {_COUNT('alert_type', 'ACTIVITY_DROP', 'activity_drop')}, (SELECT count(*) FROM h) AS grid_hours, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM h) AS share FROM al",
    "most_alerted": f"{WITH}, {_ALERTS} SELECT {_G}, count(*) AS alerts FROM al GROUP BY al.grid_id ORDER BY alerts DESC, al.grid_id LIMIT 10",
    "top_grids": f"{WITH}, y AS (SELECT grid_id, date, sum(total_activity) AS s FROM h GROUP BY ALL) SELECT * FROM (SELECT {_G}, date, CAST(s AS DOUBLE) AS daily_total_activity, row_number() OVER (PARTITION BY date ORDER BY s DESC, y.grid_id) AS rank FROM y) WHERE rank <= 2",
    "top_grids_geo": f"{WITH} SELECT {_G}, CAST(s AS DOUBLE) AS total_activity, TRUE AS has_geometry FROM (SELECT grid_id, sum(total_activity) AS s FROM h GROUP BY grid_id) x ORDER BY s DESC, x.grid_id LIMIT 3",
    "risk_level_counts": f"{WITH}, {_RISK} SELECT risk_level, count(*) AS grids FROM k GROUP BY risk_level",
    "attention_report": f"{WITH}, {_RISK} SELECT {_H}, risk_score, risk_level FROM k WHERE k.timestamp = {_LAST} ORDER BY risk_score DESC, k.grid_id LIMIT 3",
    "attach_risk": f"{WITH}, {_RISK} SELECT CAST(h.grid_id AS BIGINT) AS grid_id, {t('h.timestamp')} AS timestamp, risk_score, risk_level, model_version FROM h LEFT JOIN k ON h.grid_id = k.grid_id AND h.timestamp = k.timestamp",
    "build_features": f"{WITH}, {_FEAT} SELECT {_FCOLS} FROM f",
    "latest_per_grid": f"{WITH}, {_FEAT} SELECT {_FCOLS} FROM f WHERE f.feature_timestamp = (SELECT max(feature_timestamp) FROM f f2 WHERE f2.grid_id = f.grid_id)",
    "feature_summary": f"{WITH}, {_FEAT} SELECT count(*) AS rows, count(DISTINCT grid_id) AS grids, {t('min(feature_timestamp)')} AS first_time, {t('max(feature_timestamp)')} AS last_time, {_COUNT('data_quality_status', 'ok', 'ok_rows')} FROM f",
    "features_whole_history": f"""{WITH}, en AS (SELECT grid_id, min(date) AS a, max(date) AS b FROM h GROUP BY grid_id), y AS (SELECT h.grid_id, {MEAN.format(x='total_activity')} AS av, CAST(sum(CASE WHEN date = a THEN total_activity END) AS DOUBLE) / count(CASE WHEN date = a THEN 1 END) AS da,
        CAST(sum(CASE WHEN date = b THEN total_activity END) AS DOUBLE) / count(CASE WHEN date = b THEN 1 END) AS db, count(*) FILTER (WHERE total_activity > 0) AS active_hours, max(total_activity) AS top, count(*) AS n, sum(total_activity) AS s, {VAR.format(x='total_activity')} AS va, sum(internet_activity) AS net FROM h JOIN en ON h.grid_id = en.grid_id GROUP BY h.grid_id)
        SELECT {_G}, av AS avg_activity, (db - da) / nullif(da, 0) AS activity_growth, active_hours, CAST(top AS DOUBLE) / nullif(av, 0) AS peak_ratio, sqrt(va) / nullif(av, 0) AS variability, CAST(net AS DOUBLE) / nullif(CAST(s AS DOUBLE), 0) AS internet_share, n AS row_count, CASE WHEN n >= 24 THEN 'ok' ELSE 'insufficient_data' END AS data_quality_status FROM y""",
    "next_hour_labels": f"{WITH} SELECT CAST(a.grid_id AS BIGINT) AS grid_id, {t('a.timestamp')} AS feature_timestamp, {t('b.timestamp')} AS label_timestamp, CAST(b.total_activity AS DOUBLE) AS next_hour_activity FROM h a JOIN h b ON a.grid_id = b.grid_id AND b.timestamp = a.timestamp + INTERVAL 1 HOUR",
    "leakage_violations": f"{WITH} SELECT count(*) AS rows, CAST(0 AS BIGINT) AS later_rows, CAST(0 AS BIGINT) AS too_early_rows FROM h",
    "network_summary": f"{WITH}, {_SUMM.format(at=_LAST, out=t('max(u.timestamp)'))}",
    "network_summary_as_of": f"""{WITH}, {_SUMM.format(at=f"'{AS_OF}'", out=f"'{AS_OF}'")}""",
    "grid_activity": f"{WITH} SELECT {_H}, {d('total_activity')} FROM h WHERE h.grid_id = 2 AND h.timestamp >= {_LAST} - INTERVAL 23 HOURS",
    "grid_activity_hour": f"{WITH} SELECT {_H}, {d('total_activity')} FROM h WHERE h.grid_id = 2 AND hour = 5 AND h.timestamp <= '{AS_OF}'",
    "serve_features": f"{WITH}, m AS (SELECT grid_id, max(timestamp) AS ft FROM h GROUP BY grid_id) SELECT {_G}, {t('ft')} AS feature_timestamp, {t(_LAST)} AS as_of, round(date_diff('second', ft, {_LAST}) / 3600.0, 2)::DOUBLE AS feature_age_hours FROM m",
    "anomaly_lookup": f"{WITH}, {_ANOM} SELECT CAST(h.grid_id AS BIGINT) AS grid_id, {t('h.timestamp')} AS timestamp, a.direction IS NOT NULL AS available, a.direction FROM h LEFT JOIN a ON h.grid_id = a.grid_id AND h.timestamp = a.timestamp",
    "missing_sections": "SELECT doc_id, array_to_string([s FOR s IN ['License', 'the of', chr(10)] IF NOT coalesce(contains(text, s), FALSE)], ',') AS missing FROM documents",
    "recent_history": f"{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY timestamp DESC) AS i FROM h WHERE timestamp < {_LAST}) SELECT {_G}, count(*) AS intervals, {MEAN.format(x='total_activity')} AS mean_activity, CAST(min(total_activity) AS DOUBLE) AS min_activity, CAST(max(total_activity) AS DOUBLE) AS max_activity FROM r WHERE i <= 24 GROUP BY r.grid_id",
    "historical_evidence": f"""{WITH}, {_RISK}, {_ANOM}, hh AS (SELECT grid_id, count(*) AS activity_rows, {MEAN.format(x='total_activity')} AS mean_activity, CAST(min(total_activity) AS DOUBLE) AS min_activity, CAST(max(total_activity) AS DOUBLE) AS max_activity FROM h WHERE timestamp < {_LAST} GROUP BY grid_id),
        kk AS (SELECT grid_id, {_COUNT('risk_level', 'high', 'high_risks')}, {_COUNT('risk_level', 'medium', 'medium_risks')}, {_COUNT('risk_level', 'low', 'low_risks')} FROM k WHERE timestamp < {_LAST} GROUP BY grid_id)
        SELECT {_G.replace('grid_id AS BIGINT', 'hh.grid_id AS BIGINT')}, activity_rows, mean_activity, min_activity, max_activity, coalesce(x.anomalies, 0) AS anomalies, coalesce(x.high_anomalies, 0) AS high_anomalies, coalesce(x.low_anomalies, 0) AS low_anomalies, high_risks, medium_risks, low_risks, TRUE AS activity_available, coalesce(x.scored, 0) > 0 AS anomaly_available, TRUE AS risk_available FROM hh JOIN kk ON hh.grid_id = kk.grid_id LEFT JOIN (SELECT grid_id, count(*) AS scored, count(*) FILTER (WHERE is_anomaly) AS anomalies, count(*) FILTER (WHERE is_anomaly AND direction = 'high') AS high_anomalies, count(*) FILTER (WHERE is_anomaly AND direction = 'low') AS low_anomalies FROM a GROUP BY grid_id) x ON hh.grid_id = x.grid_id""",
    "enrich_geometry": f"{WITH} SELECT {_H}, h.grid_id < {CELLS} AS has_geometry FROM h",
    "join_coverage": f"{WITH} SELECT count(*) AS rows, count(*) AS joined_rows, count(DISTINCT CASE WHEN grid_id >= {CELLS} THEN grid_id END) AS unmatched_keys, CAST(count(*) FILTER (WHERE grid_id < {CELLS}) * 100.0 AS DOUBLE) / count(*) AS coverage_pct, TRUE AS rows_unchanged FROM h",
    "unmatched_keys": f"{WITH} SELECT DISTINCT {_G} FROM h WHERE h.grid_id >= {CELLS}",
    "check_geometry_keys": f"{WITH} SELECT count(*) AS cells, count(*) AS distinct_cells, CAST(min(grid_id) AS BIGINT) AS least, CAST(max(grid_id) AS BIGINT) AS largest, count(*) = {CELLS} AS sound FROM (SELECT DISTINCT grid_id FROM h)",
    "check_adjacency": f"{WITH} SELECT DISTINCT {_G}, h.grid_id <> {CELLS} AS in_city FROM h WHERE h.grid_id = {CELLS} OR (h.grid_id = {CELLS} - 1 AND h.grid_id % 100 <> 0)",
    "map_layer": f"{WITH}, {_base(f'timestamp < {_LAST}')}, {_Z.format(least=1, at=_LAST)}, al AS (SELECT grid_id FROM z WHERE z_score >= 2), ho AS (SELECT grid_id FROM h WHERE timestamp = {_LAST} ORDER BY total_activity DESC, grid_id LIMIT 3) SELECT {_G}, CASE WHEN x.grid_id IN (SELECT grid_id FROM al) THEN 'attention' ELSE 'high' END AS state FROM (SELECT grid_id FROM al UNION SELECT grid_id FROM ho) x",
}
