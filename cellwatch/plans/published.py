"""Queries that write, commit and read again: publication, snapshots, round trips of layers, and the gated stream.

Each works in a new folder under ``spark.checkpoint.dir``.
"""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from cellwatch.adapters import cell_count, square_cells
from cellwatch.operators import aggregate as agg, features as ft, incremental as inc, risk as rk, serving as sv, signals as sg
from cellwatch.plans.batch import _audit
from cellwatch.plans.common import CELLS, WITH, cleaned, d, hourly, plain, t
from cellwatch.plans.signals import AT, ORACLES as SIGNALS, _ANOM
from cellwatch.plans.model import ORACLES as MODEL, _model
from cellwatch.plans.stored import _GATE, _lines, _verdicts
from cellwatch.sources import activity
from cellwatch.sources.content import content_differences
from cellwatch.sources.gate import NAME_DATE, audit_records, detect_files, gate, route_once
from cellwatch.sources.versions import VersionedTable, read_table, work_folder
from cellwatch.streaming.gated import publish_gated_stream, read_lines_stream


def _published(s, sf):
    """The first half of the fact with wrong totals, then the right rows of some days, some new, twice."""
    path, h = work_folder(s, "fact"), hourly(s, sf)
    wrong = F.when(F.col("date") >= "2024-01-10", F.col("total_activity") + 1).otherwise(F.col("total_activity")).cast(h.schema["total_activity"].dataType)
    activity.publish(path, h.where("date < '2024-01-20'").withColumn("total_activity", wrong))
    for _ in range(2):
        activity.publish(path, h.where("date >= '2024-01-10'"))
    return read_table(s, path).select("grid_id", "timestamp", "total_activity")


def _snapshots(s, sf):
    """Anomaly scores of two instants, the second first wrong and then replaced."""
    path, h = work_folder(s, "snapshots"), hourly(s, sf)
    scores = lambda at: sg.anomaly_scores(h, at).select("grid_id", "timestamp", "anomaly_score", "direction")
    activity.replace_snapshot(scores(AT).withColumn("timestamp", F.col("timestamp") - F.expr("INTERVAL 1 HOUR")), path)
    activity.replace_snapshot(scores(AT).withColumn("anomaly_score", F.lit(0.0)), path)
    activity.replace_snapshot(scores(AT), path)
    return read_table(s, path).drop("snapshot")


def _layers(s, sf):
    """Clean and hourly rows written, read again and compared; the hourly layer's copy is damaged in one cell of one day."""
    path = work_folder(s, "layers")
    rows, h = cleaned(s, sf).withColumn("date", F.to_date("date")), hourly(s, sf).select(*activity.HOURLY_COLUMNS)
    activity.write_processed(rows, f"{path}/clean")
    activity.write_hourly(h, f"{path}/hourly")
    hit = (F.col("grid_id") == 1) & (F.col("timestamp") == F.lit("2024-01-05 00:00:00").cast("timestamp"))
    kind = h.schema["total_activity"].dataType
    activity.write_hourly(h.withColumn("total_activity", F.when(hit, F.col("total_activity") + 1).otherwise(F.col("total_activity")).cast(kind)), f"{path}/damaged")
    told = [activity.verify_roundtrip(rows, f"{path}/clean", ("grid_id", "timestamp", "country_code")), activity.verify_roundtrip(h, f"{path}/hourly"), activity.verify_roundtrip(h, f"{path}/damaged")]
    return [x.select(F.lit(n).alias("layer"), "written_rows", "read_rows", F.array_join("changed", ",").alias("changed"), "same_schema", "sound") for n, x in zip(("clean", "hourly", "damaged"), told)]


def _incremental(s, sf):
    """The fact and its stored sums: first the early days with wrong totals, then the rest and the late corrections."""
    path, h = work_folder(s, "sums"), hourly(s, sf)
    wrong = (F.col("total_activity") + F.when(F.col("hour") % 5 == 0, 3).otherwise(0)).cast(h.schema["total_activity"].dataType)
    activity.publish(f"{path}/fact", h.where("date < '2024-01-20'").withColumn("total_activity", wrong))
    inc.update_statistics(s, f"{path}/sums", read_table(s, f"{path}/fact"))
    for changed in (h.where("date >= '2024-01-20'"), h.where("date < '2024-01-20' AND hour % 5 = 0")):
        activity.publish(f"{path}/fact", changed)
        inc.update_statistics(s, f"{path}/sums", read_table(s, f"{path}/fact"), changed)
    return read_table(s, f"{path}/sums"), read_table(s, f"{path}/fact")


def _scores_from_sums(s, sf):
    sums, fact = _incremental(s, sf)
    return sg.anomaly_scores(fact, AT, inc.baselines_from(sums, fact, AT, "hour_of_day")).drop("reason")


def _leaks(s, sf):
    """The sound features, and two that look ahead: by an hour, and at the cell's whole history."""
    h = hourly(s, sf).select("grid_id", "timestamp", "total_activity", "internet_activity")
    ahead = Window.partitionBy("grid_id").orderBy(F.unix_timestamp("timestamp")).rangeBetween(-82800, 3600)
    timed = lambda df, w: df.select("grid_id", F.col("timestamp").alias("feature_timestamp"), F.sum("total_activity").over(w).alias("x"))
    builds = {"sound": ft.build_features, "next hour": lambda df: timed(df, ahead), "whole history": lambda df: timed(df, Window.partitionBy("grid_id"))}
    told = [ft.leakage_by_change(h, build, AT).select(F.lit(name).alias("features"), "rows", "changed") for name, build in builds.items()]
    return _union(told)


def _compacted(s, sf):
    """A fact of many small files, compacted; rows, files and whether they keep to the target, by date."""
    table = VersionedTable(s, work_folder(s, "compact"), ("date",))
    table.commit(hourly(s, sf).select(*activity.HOURLY_COLUMNS).repartition(6))
    table.compact(1 << 20)
    files = table.layout().select(F.regexp_extract("part", "date=(.*)", 1).alias("date"), "files", (F.col("bytes") <= F.col("files") * (1 << 20)).alias("within_target"))
    return table.read().groupBy("date").agg(F.count("*").alias("rows"), F.countDistinct("grid_id", "timestamp").alias("distinct_rows")).join(files, "date")


def _differences(s, sf):
    """Days of two facts of which the second lacks a cell on one day and has a day less."""
    h = hourly(s, sf).select("grid_id", "timestamp", "total_activity", "date")
    return content_differences(h, h.where("NOT (grid_id = 1 AND date = '2024-01-07') AND date <> '2024-01-09'"))


def _land(s, lines, folder):
    """Each name's lines as one file of that name in a folder."""
    fs = s._jvm.org.apache.hadoop.fs
    store = fs.Path(folder).getFileSystem(s._jsparkSession.sessionState().newHadoopConf())
    lines.select("name", "value", "place").repartition("name").sortWithinPartitions("name", "place").select("name", "value").write.partitionBy("name").text(f"{folder}-aside")
    store.mkdirs(fs.Path(folder))
    for f in store.globStatus(fs.Path(f"{folder}-aside/name=*/part-*")) or []:  # one file a day
        store.rename(f.getPath(), fs.Path(f"{folder}/{f.getPath().getParent().getName().partition('=')[2]}"))
    return folder


def _day():
    return F.dayofmonth(F.to_date(F.regexp_extract("name", NAME_DATE, 1)))


def _read_files(s, sf):
    """Rows of the daily files with the required columns, by their file; a number that can't be read keeps its row's text."""
    rows = activity.with_source_file(activity.read_activity(s, _land(s, _lines(s, sf).where(_day() % 6 < 4), f"{work_folder(s, 'files')}/in")))
    sound = F.count_if(F.col(activity.CORRUPT).isNull())
    return rows.groupBy("source_file").agg(F.count("*").alias("rows"), sound.alias("sound_rows"), F.round(F.sum("internet"), 4).alias("internet"), F.max("CellID").cast("bigint").alias("last_cell"))


def _routed(s, sf):
    """The zone of every file after two runs; the second finds all of them done."""
    path = work_folder(s, "route")
    verdicts = gate(s, _land(s, _lines(s, sf), f"{path}/in"), _audit(s, sf))
    for run in ("first", "second"):
        records = route_once(verdicts, f"{path}/accepted", f"{path}/rejected", f"{path}/manifest", run)
    zones = [detect_files(s, f"{path}/{z}").select("name", F.lit(z).alias("zone"), (F.col("length") > 0).alias("whole")) for z in ("accepted", "rejected")]
    return zones[0].union(zones[1]).join(records.select("name", "run"), "name")


def _audited(s, sf):
    """Records of two runs, appended; those of one run keep their times."""
    path = work_folder(s, "audit")
    for _ in range(2):
        activity.append_audit(audit_records(_verdicts(s, sf)), path)
    rows = s.read.schema("name string, status string, row_count bigint, reason string, processed_at timestamp").json(path)
    return rows.groupBy("name", "status").agg(F.count("*").alias("records"), F.max("row_count").alias("row_count"), F.count("processed_at").alias("timed"))


def _reported(s, sf):
    """Daily figures as one CSV file and as JSON, read again."""
    path, daily = work_folder(s, "report"), agg.daily_kpis(hourly(s, sf)).select("date", F.col("total_activity").cast("double").alias("total_activity"))
    activity.write_report(daily, f"{path}/csv")
    activity.write_run_metrics(daily, f"{path}/json")
    schema = "date string, total_activity double"
    both = {"csv": s.read.schema(schema).option("header", True).csv(f"{path}/csv"), "json": s.read.schema(schema).json(f"{path}/json")}
    return both["csv"].withColumn("kind", F.lit("csv")).union(both["json"].withColumn("kind", F.lit("json")))


def _united(s, sf):
    """The fact as a folder for each of its dates, put together by hand."""
    path, h = work_folder(s, "parts"), hourly(s, sf).select("grid_id", "timestamp", "total_activity", "date").persist()
    try:
        days = [r.date for r in h.select("date").distinct().collect()]  # one a day
        h.write.partitionBy("date").parquet(path)
    finally:
        h.unpersist()
    return activity.union_partitions(s, {d: f"{path}/date={d}" for d in days})


def _refreshed(s, sf):
    """A derived table made new twice from itself: late hours only, then doubled."""
    path = work_folder(s, "derived")
    activity.refresh(hourly(s, sf).select("grid_id", "timestamp", "total_activity"), path)
    activity.refresh(read_table(s, path).where("timestamp >= '2024-01-18'"), path)
    activity.refresh(read_table(s, path).withColumn("total_activity", F.col("total_activity") * 2), path)
    return read_table(s, path)


def _loaded(s, sf):
    """A fitted model, saved and loaded."""
    path = work_folder(s, "model")
    rk.save_model(_model(s, sf), path, "lr-1", 1.0)
    model, told = rk.load_model(s, path)
    return rk.coefficients(s, model).select("rank", "feature", F.round("coefficient", 6).alias("coefficient"), F.lit(told["version"]).alias("version"))


def _geometry(s, sf):
    """A GeoJSON file with a square for each cell of the events, read again."""
    path, n = work_folder(s, "geo"), cell_count(s, sf)
    cells = square_cells(s, n).select(F.struct((F.col("grid_id") - 1).alias("id"), F.struct(F.col("grid_id").alias("cellId")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates")).alias("geometry")).alias("f"))
    whole = cells.agg(F.sort_array(F.collect_list("f")).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")))  # a city's cells
    whole.coalesce(1).write.text(path)
    return activity.read_grid_geometry(s, path).select("grid_id", F.size("ring").alias("corners"), F.round(F.col("ring")[0][0], 9).alias("lon"), F.round(F.col("ring")[0][1], 9).alias("lat"))


def _streamed(s, sf):
    """Each day's lines as a file that lands in a folder; accepted names come again with other rows, and leave the fact as it is."""
    path = work_folder(s, "stream")

    def land(lines, zone):
        _land(s, lines, f"{path}/in/{zone}")
        publish_gated_stream(read_lines_stream(s, f"{path}/in"), f"{path}/fact", f"{path}/audit", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()

    lines = _lines(s, sf)
    land(lines, "first")
    land(lines.withColumn("value", F.regexp_replace("value", r"(,[0-9]+\.[0-9]{2})", "$1" + "1")), "again")
    verdicts = read_table(s, f"{path}/audit").groupBy("name").agg(F.count_if(F.col("status") == "accepted").alias("accepted"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("status") == "skipped_duplicate").alias("skipped"))
    days = read_table(s, f"{path}/fact").groupBy("date").agg(F.count("*").alias("cell_hours"), F.round(F.sum("total_activity"), 4).alias("total_activity"))
    at = F.concat(F.lit("sms-call-internet-mi-"), "date", F.lit(".csv"))
    return verdicts.join(days.withColumn("name", at), "name", "left").select("name", "accepted", "rejected", "skipped", F.coalesce("cell_hours", F.lit(0)).alias("cell_hours"), F.coalesce("total_activity", F.lit(0.0)).alias("total_activity"))


QUERIES = {
    "publish": lambda s, sf: plain(_published(s, sf)),
    "replace_snapshot": lambda s, sf: plain(_snapshots(s, sf)),
    "verify_roundtrip": lambda s, sf: plain(_union(_layers(s, sf))),
    "content_differences": lambda s, sf: plain(_differences(s, sf)),
    "baselines_from_sums": lambda s, sf: plain((lambda sums, fact: inc.baselines_from(sums, fact))(*_incremental(s, sf))),
    "anomaly_scores_from_sums": lambda s, sf: plain(_scores_from_sums(s, sf)),
    "network_history": lambda s, sf: plain(sv.network_history(hourly(s, sf))),
    "compact": lambda s, sf: plain(_compacted(s, sf)),
    "leakage_by_change": lambda s, sf: plain(_leaks(s, sf)),
    "read_activity": lambda s, sf: _read_files(s, sf),
    "detect_files": lambda s, sf: detect_files(s, _land(s, _lines(s, sf), f"{work_folder(s, 'files')}/in")).select("name", (F.col("length") > 0).alias("there")),
    "route": lambda s, sf: _routed(s, sf),
    "append_audit": lambda s, sf: _audited(s, sf),
    "write_report": lambda s, sf: _reported(s, sf),
    "union_partitions": lambda s, sf: plain(_united(s, sf)),
    "refresh": lambda s, sf: plain(_refreshed(s, sf)),
    "save_model": lambda s, sf: plain(_loaded(s, sf)),
    "read_grid_geometry": lambda s, sf: plain(_geometry(s, sf)),
    "gated_stream": lambda s, sf: _streamed(s, sf),
}


def _union(parts):
    return parts[0].union(parts[1]).union(parts[2])


_G = "CAST(grid_id AS BIGINT) AS grid_id"
_BAD = "(c = 1 AND event_id % 97 = 0) OR (c = 3 AND event_id % 97 = 0) OR (c IN (1, 2) AND event_id % 89 = 0) OR c IN (4, 5)"
ORACLES = {
    "publish": f"{WITH} SELECT {_G}, {t('timestamp')} AS timestamp, {d('total_activity')} FROM h",
    "replace_snapshot": f"{WITH}, {_ANOM} SELECT {_G}, {t('timestamp')} AS timestamp, anomaly_score, direction FROM a UNION ALL SELECT {_G}, {t('timestamp - INTERVAL 1 HOUR')}, anomaly_score, direction FROM a",
    "verify_roundtrip": f"""{WITH}, hit AS (SELECT count(*) > 0 AS there FROM h WHERE grid_id = 1 AND timestamp = TIMESTAMP '2024-01-05 00:00:00'), c AS (SELECT count(*) AS n, (SELECT count(*) FROM (SELECT 1 FROM clean GROUP BY grid_id, timestamp, country_code HAVING count(*) > 1)) = 0 AS single FROM clean)
        SELECT 'clean' AS layer, n AS written_rows, n AS read_rows, '' AS changed, TRUE AS same_schema, single AS sound FROM c
        UNION ALL SELECT 'hourly', count(*), count(*), '', TRUE, TRUE FROM h
        UNION ALL SELECT 'damaged', count(*), count(*), CASE WHEN (SELECT there FROM hit) THEN '2024-01-05' ELSE '' END, TRUE, NOT (SELECT there FROM hit) FROM h""",
    "content_differences": f"{WITH}, x AS (SELECT date, count(*) AS rows_a, count(*) FILTER (WHERE NOT (grid_id = 1 AND date = '2024-01-07') AND date <> '2024-01-09') AS rows_b FROM h GROUP BY date) SELECT date, rows_a, rows_b, rows_a = rows_b AS same FROM x",
    "baselines_from_sums": SIGNALS["baselines"],
    "anomaly_scores_from_sums": SIGNALS["anomaly_scores"],
    "network_history": f"""{WITH}, ts AS (SELECT DISTINCT timestamp AS as_of FROM h), u AS (SELECT as_of, h.* FROM ts JOIN h ON h.timestamp <= ts.as_of),
        a AS (SELECT as_of, sum(total_activity) AS s, count(DISTINCT CASE WHEN total_activity > 0 THEN grid_id END) AS n FROM u GROUP BY as_of),
        p AS (SELECT as_of, hour, sum(total_activity) AS s FROM u GROUP BY as_of, hour QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY sum(total_activity) DESC, hour) = 1),
        g AS (SELECT as_of, grid_id, sum(total_activity) AS s FROM u GROUP BY as_of, grid_id QUALIFY row_number() OVER (PARTITION BY as_of ORDER BY sum(total_activity) DESC, grid_id) = 1)
        SELECT {t('a.as_of')} AS as_of, CAST(a.s AS DOUBLE) AS total_activity, a.n AS active_grids, p.hour AS peak_hour, CAST(p.s AS DOUBLE) AS peak_hour_activity, CAST(g.grid_id AS BIGINT) AS top_grid, CAST(g.s AS DOUBLE) AS top_grid_activity FROM a JOIN p USING (as_of) JOIN g USING (as_of)""",
    "compact": f"{WITH} SELECT date, count(*) AS rows, count(*) AS distinct_rows, CAST(1 AS BIGINT) AS files, TRUE AS within_target FROM h GROUP BY date",
    "leakage_by_change": f"""{WITH}, x AS (SELECT grid_id, timestamp AS ts, timestamp <= TIMESTAMP '{AT}' AS early FROM h), e AS (SELECT * FROM x WHERE early), l AS (SELECT * FROM x WHERE NOT early)
        SELECT 'sound' AS features, count(*) AS rows, CAST(0 AS BIGINT) AS changed FROM e
        UNION ALL SELECT 'next hour', count(*), count(*) FILTER (WHERE EXISTS (SELECT 1 FROM l WHERE l.grid_id = e.grid_id AND l.ts <= e.ts + INTERVAL 1 HOUR)) FROM e
        UNION ALL SELECT 'whole history', count(*), count(*) FILTER (WHERE grid_id IN (SELECT grid_id FROM l)) FROM e""",
    "read_activity": """WITH e AS (SELECT *, day(ts) % 6 AS c, 'sms-call-internet-mi-' || strftime(ts, '%Y-%m-%d') || '.csv' AS source_file, CAST(value AS DECIMAL(18,2)) AS v FROM events),
        x AS (SELECT *, c = 3 AND event_id % 97 = 0 AS odd, CASE WHEN c IN (1, 2) AND event_id % 89 = 0 THEN -v ELSE v END AS w FROM e WHERE c < 4)
        SELECT source_file, count(*) AS rows, count(*) FILTER (WHERE NOT odd) AS sound_rows, round(CAST(sum(w) FILTER (WHERE event_type = 'purchase' AND NOT odd) AS DOUBLE), 4) AS internet, CAST(max(user_id + 1) AS BIGINT) AS last_cell FROM x GROUP BY source_file""",
    "detect_files": "SELECT DISTINCT 'sms-call-internet-mi-' || strftime(ts, '%Y-%m-%d') || '.csv' AS name, TRUE AS there FROM events",
    "route": f"WITH {_GATE} SELECT name, status AS zone, TRUE AS whole, 'first' AS run FROM ve WHERE status <> 'skipped_duplicate'",
    "append_audit": f"WITH {_GATE} SELECT name, status, CAST(2 AS BIGINT) AS records, row_count, CAST(2 AS BIGINT) AS timed FROM ve",
    "write_report": f"{WITH}, x AS (SELECT date, CAST(sum(total_activity) AS DOUBLE) AS total_activity FROM h GROUP BY date) SELECT *, 'csv' AS kind FROM x UNION ALL SELECT *, 'json' FROM x",
    "union_partitions": f"{WITH} SELECT {_G}, {t('timestamp')} AS timestamp, {d('total_activity')}, date FROM h",
    "refresh": f"{WITH} SELECT {_G}, {t('timestamp')} AS timestamp, CAST(2 * total_activity AS DOUBLE) AS total_activity FROM h WHERE h.timestamp >= '2024-01-18'",
    "save_model": f"SELECT *, 'lr-1' AS version FROM ({MODEL['fit_risk_model']})",
    "read_grid_geometry": f"SELECT g AS grid_id, CAST(5 AS BIGINT) AS corners, round(9.0::DOUBLE + ((g - 1) % 100) * 0.003::DOUBLE, 9) AS lon, round(45.35::DOUBLE + ((g - 1) // 100) * 0.003::DOUBLE, 9) AS lat FROM (SELECT unnest(range(1, {CELLS} + 1)) AS g)",
    "gated_stream": f"""WITH e AS (SELECT *, day(ts) % 6 AS c, strftime(ts, '%Y-%m-%d') AS date FROM events),
        v AS (SELECT date, count(*) FILTER (WHERE {_BAD}) = 0 AS ok, count(DISTINCT user_id * 100 + hour(ts)) AS cell_hours, round(CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE), 4) AS total FROM e GROUP BY date)
        SELECT 'sms-call-internet-mi-' || date || '.csv' AS name, CAST(ok AS BIGINT) AS accepted, CASE WHEN ok THEN 0 ELSE 2 END AS rejected, CAST(ok AS BIGINT) AS skipped, CASE WHEN ok THEN cell_hours ELSE 0 END AS cell_hours, CASE WHEN ok THEN total ELSE 0.0 END AS total_activity FROM v""",
}
