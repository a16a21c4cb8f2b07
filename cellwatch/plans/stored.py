"""Queries on the file gate, run health, locations and evidence packages; nested packages are laid out as flat columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwatch.operators import quality as ql
from cellwatch.operators.serving import grid_location
from cellwatch.plans.common import MEAN, WITH, hourly, plain, t
from cellwatch.plans.batch import _audit, _files
from cellwatch.plans.model import _SCORE, _curated, _evidence, _full, _health
from cellwatch.plans.signals import _ANOM, _COUNT, _FEAT, _LAST, _SUMM, _Z, _base, _dim
from cellwatch.sources.gate import REQUIRED, gate_totals, headers_of, quality_of, verdicts_of
from cellwatch.adapters import CHANNELS


def _lines(s, sf):
    """Each day's events as a file of lines under a header, with faults by the day of the month."""
    e = s.read.parquet(f"{sf}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    name = F.concat(F.lit("sms-call-internet-mi-"), F.date_format("ts", "yyyy-MM-dd"), F.lit(".csv"))
    case, id_ = F.dayofmonth("ts") % 6, F.col("event_id")
    time = F.when((case == 1) & (id_ % 97 == 0), "NOT-A-DATE").otherwise(F.date_format(F.date_trunc("hour", "ts"), "yyyy-MM-dd HH:mm:ss"))
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    amount = F.when((case == 3) & (id_ % 97 == 0), "abc").when(case.isin(1, 2) & (id_ % 89 == 0), F.concat(F.lit("-"), amount)).otherwise(amount)
    cells = [time, (F.col("user_id") + 1).cast("string"), F.get_json_object("props", "$.k")]
    cells += [F.when(F.col("event_type") == kind, F.col("amount")).otherwise("") for kind in CHANNELS]
    row = F.concat_ws(",", *cells[:-1], F.when(case == 4, None).otherwise(cells[-1]), F.when(case == 5, "1"))  # nulls are left out
    head = F.when(case == 4, ",".join(REQUIRED[:-1])).when(case == 5, ",".join([*REQUIRED, "more"])).otherwise(",".join(REQUIRED))
    place = lambda c: F.struct(F.lit(0).cast("bigint").alias("block"), c.cast("bigint").alias("id"))
    rows = e.withColumn("amount", amount).select(name.alias("name"), row.alias("value"), place(id_).alias("place"))
    return rows.unionByName(e.select(F.to_date("ts").alias("ts")).distinct().select(name.alias("name"), head.alias("value"), place(F.lit(-1)).alias("place")))


def _headers(s, sf):
    return headers_of(_lines(s, sf), _files(s, sf))


def _quality(s, sf):
    return quality_of(_lines(s, sf), _headers(s, sf))


def _verdicts(s, sf):
    return verdicts_of(_headers(s, sf), _quality(s, sf), _audit(s, sf))


def _daily_runs(s, sf):
    """A run record for each day of the data; the scoring task of every fifth day failed."""
    days = hourly(s, sf).groupBy("date").agg(F.count("*").alias("rows_published"), F.max("timestamp").alias("as_of"))
    scored = F.when(F.dayofmonth("as_of") % 5 == 0, "failed").otherwise("success")
    return days.select(F.concat(F.lit("run-"), "date").alias("run_id"), F.create_map(F.lit("ingest"), F.lit("success"), F.lit("score"), scored).alias("per_task_status"), "rows_published", "as_of")


def _location(s, sf):
    there = grid_location(_dim(s, sf)).join(hourly(s, sf).select("grid_id").distinct(), "grid_id")
    return there.withColumns({c: F.round(c, 9) for c in ("centroid_lat", "centroid_lon")})


def _evidence_flat(s, sf):
    f, a, r = "features", "anomaly", "risk"
    return _evidence(s, sf).select(
        "grid_id", f"{f}.feature_timestamp", f"{f}.avg_activity", f"{f}.data_quality_status", f"{a}.direction", F.round(f"{a}.anomaly_score", 9).alias("anomaly_score"),
        F.size("alerts").alias("n_alerts"), F.get("alerts", F.lit(0))["severity"].alias("severity"), F.round(f"{r}.risk_score", 9).alias("risk_score"), f"{r}.risk_level", "missing", F.length("note").alias("note_chars"),
    )


def _curated_flat(s, sf):
    c = "context"
    return _curated(s, sf).select(
        "grid_id", f"{c}.evidence.features.feature_timestamp", f"{c}.evidence.missing", f"{c}.recent.intervals", F.col(f"{c}.recent.mean_activity").alias("recent_mean"),
        *(f"{c}.history.{x}" for x in ("activity_rows", "anomalies", "high_risks", "medium_risks", "low_risks")), f"{c}.pipeline.run_id", f"{c}.pipeline.reasons", f"{c}.pipeline.healthy",
    )


def _full_flat(s, sf):
    c = "context"
    return _full(s, sf).select(
        "grid_id", F.coalesce(F.size(f"{c}.series"), F.lit(0)).alias("series_hours"), F.get(f"{c}.series", F.lit(0))["timestamp"].alias("series_first"), f"{c}.location.reference",
        F.size(f"{c}.hotspots").alias("hotspot_cells"), F.get(f"{c}.hotspots", F.lit(0))["grid_id"].alias("hottest"), *(f"{c}.summary.{x}" for x in ("total_activity", "peak_hour", "top_grid")),
        f"{c}.evidence.missing", f"{c}.pipeline.healthy",
    )


QUERIES = {
    "check_headers": lambda s, sf: plain(_headers(s, sf)),
    "check_quality": lambda s, sf: plain(_quality(s, sf)),
    "gate": lambda s, sf: plain(_verdicts(s, sf)),
    "gate_totals": lambda s, sf: plain(gate_totals(_verdicts(s, sf))),
    "pipeline_health": lambda s, sf: plain(_health(s, sf)),
    "pipeline_health_daily": lambda s, sf: plain(ql.pipeline_health(_daily_runs(s, sf), hourly(s, sf)).select("run_id", "reasons", "freshness_hours", "healthy")),
    "grid_location": lambda s, sf: plain(_location(s, sf)),
    "grid_evidence": lambda s, sf: plain(_evidence_flat(s, sf)),
    "incident_context": lambda s, sf: plain(_curated_flat(s, sf)),
    "incident_context_full": lambda s, sf: plain(_full_flat(s, sf)),
}

_G = "CAST(grid_id AS BIGINT) AS grid_id"
_KIND = "CASE event_type " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in CHANNELS.items()) + " END"
_GATE = f"""g AS (SELECT event_id, 'sms-call-internet-mi-' || strftime(ts, '%Y-%m-%d') || '.csv' AS name, day(ts) % 6 AS c, {_KIND} AS measure FROM events),
  g2 AS (SELECT *, CASE WHEN c = 1 AND event_id % 97 = 0 THEN 'invalid timestamp: NOT-A-DATE' WHEN c = 3 AND event_id % 97 = 0 THEN 'non-numeric ' || measure || ': abc' WHEN c IN (1, 2) AND event_id % 89 = 0 THEN 'negative ' || measure END AS why FROM g),
  g3 AS (SELECT *, min(CASE WHEN why IS NOT NULL THEN event_id END) OVER (PARTITION BY name) AS bad FROM g2),
  g4 AS (SELECT name, min(c) AS c, count(*) AS rows, count(*) FILTER (WHERE event_id < bad) AS before, max(why) FILTER (WHERE event_id = bad) AS why FROM g3 GROUP BY name),
  q AS (SELECT name, CASE c WHEN 4 THEN 'missing columns: internet' WHEN 5 THEN 'extra columns: more' END AS header_reason, CASE c WHEN 4 THEN '{",".join(REQUIRED[:-1])}' WHEN 5 THEN '{",".join(REQUIRED)},more' ELSE '{",".join(REQUIRED)}' END AS header,
    CASE WHEN c IN (4, 5) THEN 0 ELSE rows END AS row_count, CASE WHEN c IN (4, 5) THEN 0 ELSE before END AS rows_to_first_error, CASE WHEN c IN (4, 5) THEN 'the file has no data rows' ELSE why END AS quality_reason FROM g4),
  v AS (SELECT name, name < 'sms-call-internet-mi-2024-01-15.csv' AS done, row_count, rows_to_first_error, coalesce(header_reason, quality_reason) AS why FROM q),
  ve AS (SELECT name, CASE WHEN done THEN 'skipped_duplicate' WHEN why IS NOT NULL THEN 'rejected' ELSE 'accepted' END AS status, row_count, rows_to_first_error, CASE WHEN NOT done THEN why END AS reason FROM v)"""
_PASSED = "(SELECT count(*) > 0 FROM f WHERE data_quality_status = 'ok' AND feature_timestamp = (SELECT max(feature_timestamp) FROM f))"
_REASONS = f"'task score is failed' || CASE WHEN {_PASSED} THEN '' ELSE ',task quality_check is failed' END"
_ALERTED = f"""{_base(f'timestamp < {_LAST}').replace('b AS', 'b2 AS', 1)}, {_Z.format(least=1, at=_LAST).replace('z AS', 'z2 AS', 1).replace('JOIN b USING', 'JOIN b2 USING')},
  al AS (SELECT grid_id, CASE WHEN z_score >= 3 THEN 'high' ELSE 'medium' END AS severity FROM z2 WHERE z_score >= 2)"""
_SCORED = f"rs AS (SELECT grid_id, feature_timestamp AS timestamp, {_SCORE} AS risk_score FROM f WHERE data_quality_status = 'ok'), rl AS (SELECT *, CASE WHEN risk_score >= 0.7 THEN 'high' WHEN risk_score >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM rs)"
_EV = f"""{_ANOM}, {_FEAT}, {_ALERTED}, {_SCORED}, lf AS (SELECT * FROM f QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY feature_timestamp DESC) = 1),
  lr AS (SELECT * FROM rl QUALIFY row_number() OVER (PARTITION BY grid_id ORDER BY timestamp DESC) = 1),
  ev AS (SELECT lf.grid_id, feature_timestamp, avg_activity, data_quality_status, a.direction, a.anomaly_score, al.severity, lr.risk_score, lr.risk_level,
    array_to_string([x FOR x IN [CASE WHEN a.grid_id IS NULL THEN 'anomaly' END, CASE WHEN al.grid_id IS NULL THEN 'alerts' END, CASE WHEN lr.grid_id IS NULL THEN 'risk' END] IF x IS NOT NULL], ',') AS missing
    FROM lf LEFT JOIN a ON a.grid_id = lf.grid_id LEFT JOIN al ON al.grid_id = lf.grid_id LEFT JOIN lr ON lr.grid_id = lf.grid_id)"""
_NOTE_CHARS = len("Alerts, anomalies and risk scores are prompts to investigate; they don't prove a fault.")

ORACLES = {
    "check_headers": f"WITH {_GATE} SELECT name, header, header_reason FROM q",
    "check_quality": f"WITH {_GATE} SELECT name, row_count, rows_to_first_error, quality_reason FROM q",
    "gate": f"WITH {_GATE} SELECT name, status, row_count, rows_to_first_error, reason FROM ve",
    "gate_totals": f"""WITH {_GATE} SELECT CAST(coalesce(sum(row_count) FILTER (WHERE status = 'accepted'), 0) AS BIGINT) AS rows_accepted, CAST(coalesce(sum(row_count) FILTER (WHERE status = 'rejected'), 0) AS BIGINT) AS rows_rejected,
        {', '.join(_COUNT('status', x, f'files_{x}') for x in ('accepted', 'rejected', 'skipped_duplicate'))}, count(*) FILTER (WHERE status = 'rejected') = 0 AS passed FROM ve""",
    "pipeline_health": f"{WITH}, {_FEAT} SELECT 'run-1' AS run_id, {_REASONS} AS reasons, 0.0::DOUBLE AS freshness_hours, FALSE AS healthy",
    "pipeline_health_daily": f"""{WITH}, r AS (SELECT date, max(timestamp) AS last FROM h GROUP BY date) SELECT 'run-' || date AS run_id,
        array_to_string([x FOR x IN [CASE WHEN day(last) % 5 = 0 THEN 'task score is failed' END, CASE WHEN last <> {_LAST} THEN 'the as-of time is not the latest of the data' END] IF x IS NOT NULL], ',') AS reasons,
        date_diff('second', last, {_LAST}) / 3600.0::DOUBLE AS freshness_hours, day(last) % 5 <> 0 AND last = {_LAST} AS healthy FROM r""",
    "grid_location": f"""{WITH}, p AS (SELECT DISTINCT grid_id, 45.35::DOUBLE + ((grid_id - 1) // 100 + 0.4::DOUBLE) * 0.003::DOUBLE AS lat, 9.0::DOUBLE + ((grid_id - 1) % 100 + 0.4::DOUBLE) * 0.003::DOUBLE AS lon FROM h)
        SELECT {_G}, round(lat, 9) AS centroid_lat, round(lon, 9) AS centroid_lon, printf('Cell %d near %.5f, %.5f', p.grid_id, lat, lon) AS reference FROM p""",
    "grid_evidence": f"{WITH}, {_EV} SELECT {_G}, {t('feature_timestamp')} AS feature_timestamp, avg_activity, data_quality_status, direction, round(anomaly_score, 9) AS anomaly_score, CAST(severity IS NOT NULL AS BIGINT) AS n_alerts, severity, round(risk_score, 9) AS risk_score, risk_level, missing, CAST({_NOTE_CHARS} AS BIGINT) AS note_chars FROM ev",
    "incident_context": f"""{WITH}, {_EV}, re AS (SELECT grid_id, count(*) AS intervals, {MEAN.format(x='total_activity')} AS recent_mean FROM (SELECT *, row_number() OVER (PARTITION BY grid_id ORDER BY timestamp DESC) AS i FROM h WHERE timestamp < {_LAST}) WHERE i <= 24 GROUP BY grid_id),
        hi AS (SELECT grid_id, count(*) AS activity_rows FROM h WHERE timestamp < {_LAST} GROUP BY grid_id), ho AS (SELECT grid_id, count(*) FILTER (WHERE is_anomaly) AS anomalies FROM a WHERE timestamp < {_LAST} GROUP BY grid_id),
        hr AS (SELECT grid_id, {', '.join(_COUNT('risk_level', x, f'{x}_risks') for x in ('high', 'medium', 'low'))} FROM rl WHERE timestamp < {_LAST} GROUP BY grid_id)
        SELECT CAST(ev.grid_id AS BIGINT) AS grid_id, {t('feature_timestamp')} AS feature_timestamp, missing, intervals, recent_mean, coalesce(activity_rows, 0) AS activity_rows, coalesce(anomalies, 0) AS anomalies, {', '.join(f'coalesce({x}_risks, 0) AS {x}_risks' for x in ('high', 'medium', 'low'))},
          'run-1' AS run_id, {_REASONS} AS reasons, FALSE AS healthy FROM ev LEFT JOIN re ON re.grid_id = ev.grid_id LEFT JOIN hi ON hi.grid_id = ev.grid_id LEFT JOIN ho ON ho.grid_id = ev.grid_id LEFT JOIN hr ON hr.grid_id = ev.grid_id""",
    "incident_context_full": f"""{WITH}, {_EV}, se AS (SELECT grid_id, count(*) AS series_hours, min(timestamp) AS series_first FROM h WHERE timestamp BETWEEN {_LAST} - INTERVAL 23 HOURS AND {_LAST} GROUP BY grid_id),
        su AS (WITH {_SUMM.format(at=_LAST, out=t('max(u.timestamp)'))}), la AS (SELECT grid_id FROM h WHERE timestamp = {_LAST} ORDER BY total_activity DESC, grid_id LIMIT 100)
        SELECT CAST(ev.grid_id AS BIGINT) AS grid_id, coalesce(series_hours, 0) AS series_hours, {t('series_first')} AS series_first,
          printf('Cell %d near %.5f, %.5f', ev.grid_id, 45.35::DOUBLE + ((ev.grid_id - 1) // 100 + 0.4::DOUBLE) * 0.003::DOUBLE, 9.0::DOUBLE + ((ev.grid_id - 1) % 100 + 0.4::DOUBLE) * 0.003::DOUBLE) AS reference,
          (SELECT count(*) FROM la) AS hotspot_cells, (SELECT CAST(grid_id AS BIGINT) FROM h WHERE timestamp = {_LAST} ORDER BY total_activity DESC, h.grid_id LIMIT 1) AS hottest, su.total_activity, su.peak_hour, su.top_grid, missing, FALSE AS healthy
        FROM ev CROSS JOIN su LEFT JOIN se ON se.grid_id = ev.grid_id""",
}
