"""File gate, layers and streaming, on small files."""

import datetime as dt
import os

import pytest
from pyspark.sql import functions as F

from cellwatch.operators.aggregate import hourly_grid_summary
from cellwatch.operators.clean import clean
from cellwatch.sources import activity, gate
from cellwatch.sources.versions import read_table
from cellwatch.streaming.hourly import read_activity_stream, stream_hourly

HEAD = "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet"


def name(day):
    return f"sms-call-internet-mi-2020-01-{day:02d}.csv"


def row(hour, day=1, smsin="1.1", time=None):
    return f"{time or f'2020-01-{day:02d} {hour:02d}:00:00'},1,39,{smsin},0.9,,0.3,10.5"


@pytest.fixture
def landing(tmp_path):
    def put(day, lines, head=HEAD):
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name(day)).write_text("\n".join([*([head] if head else []), *lines]) + ("\n" if head or lines else ""))

    put(1, [row(h) for h in range(5)])
    put(2, [row(0)[: row(0).rindex(",")]], HEAD.removesuffix(",internet"))
    put(3, [row(0) + ",1"], HEAD + ",more")
    put(4, [row(0), row(1), row(2, time="NOT-A-DATE"), row(3, smsin="-5.0")])
    put(5, [row(0), row(1, smsin="-5.0")])
    put(6, [row(0, smsin="abc")])
    put(7, [row(0, smsin="nan")])
    put(8, [])
    put(9, [], None)
    (tmp_path / "in" / "sms-call-internet-tn-2020-01-01.csv").write_text(HEAD + "\n")
    (tmp_path / "in" / "grid.geojson").write_text("{}")
    return tmp_path / "in"


def test_gate(spark, landing, tmp_path):
    told = {int(r.name[-6:-4]): r for r in gate.gate(spark, str(landing)).collect()}
    assert sorted(told) == list(range(1, 10))
    assert (told[1].status, told[1].row_count) == ("accepted", 5)
    why = {2: "internet", 3: "more", 4: "timestamp", 5: "negative", 6: "non-numeric", 7: "non-numeric", 8: "no data rows", 9: "empty"}
    for day, text in why.items():
        assert told[day].status == "rejected" and text in told[day].reason, (day, told[day])
    assert (told[4].row_count, told[4].rows_to_first_error) == (4, 2)
    verdicts = gate.gate(spark, str(landing))
    totals = gate.gate_totals(verdicts).first()
    assert totals.rows_accepted == 5 and totals.files_rejected == 8 and not totals.passed
    with pytest.raises(ValueError):
        gate.require_accepted(verdicts)
    activity.append_audit(gate.audit_records(verdicts), str(tmp_path / "audit"))
    again = {r.name: r.status for r in gate.gate(spark, str(landing), spark.read.json(str(tmp_path / "audit"))).collect()}
    assert again[name(1)] == "skipped_duplicate" and again[name(4)] == "rejected"
    gate.route(verdicts, str(tmp_path / "yes"), str(tmp_path / "no"))
    assert os.listdir(tmp_path / "yes") == [name(1)] and len(os.listdir(tmp_path / "no")) == 8
    assert (tmp_path / "yes" / name(1)).read_bytes() == (landing / name(1)).read_bytes()
    missing = gate.missing_dates(gate.detect_files(spark, str(landing)), "2020-01-08", "2020-01-12")
    assert [str(r.date) for r in missing.orderBy("date").collect()] == ["2020-01-10", "2020-01-11", "2020-01-12"]


def test_layers(spark, tmp_path):
    source = tmp_path / "raw"
    source.mkdir()
    for day in (1, 2):
        (source / name(day)).write_text("\n".join([HEAD, *(row(h, day) for h in range(24))]) + "\n")
    raw = activity.read_activity(spark, str(source))
    assert activity.with_source_file(raw).select("source_file").distinct().count() == 2
    rows = clean(raw.drop(activity.CORRUPT))
    activity.write_processed(rows, str(tmp_path / "clean"))
    assert activity.verify_roundtrip(rows.withColumn("date", F.to_date("date")), str(tmp_path / "clean")).first().sound
    hourly = hourly_grid_summary(rows)
    activity.write_hourly(hourly, str(tmp_path / "hourly"))
    assert spark.read.parquet(str(tmp_path / "hourly")).count() == 48
    sizes = {r.layer: r for r in activity.layer_sizes(spark, {"raw": str(source), "clean": str(tmp_path / "clean")}).collect()}
    assert sizes["raw"].files == 2 and sizes["raw"].ratio == 1.0
    base = str(tmp_path / "fact")
    activity.publish(base, hourly)
    changed = hourly.where("date = '2020-01-02'").withColumn("total_activity", F.lit(0.0))
    for _ in range(2):
        activity.publish(base, changed)
    back = read_table(spark, base)
    assert back.count() == 48 and back.where("total_activity = 0").count() == 24
    with pytest.raises(FileNotFoundError):
        activity.read_activity(spark, str(tmp_path / "fact"))


def test_snapshot_and_refresh(spark, tmp_path):
    t = dt.datetime(2020, 1, 1)
    one = spark.createDataFrame([(1, t, 0.1), (2, t, 0.2)], "grid_id int, timestamp timestamp, risk_score double")
    two = one.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR"))
    path = str(tmp_path / "risk")
    for df in (one, two, two.withColumn("risk_score", F.lit(0.9))):
        activity.replace_snapshot(df, path)
    back = read_table(spark, path)
    assert back.count() == 4 and back.where("risk_score = 0.9").count() == 2
    table = str(tmp_path / "table")
    activity.refresh(one, table)
    activity.refresh(read_table(spark, table).where("grid_id = 1"), table)
    assert read_table(spark, table).count() == 1


def test_geojson(spark, tmp_path):
    (tmp_path / "g.geojson").write_text('{"type":"FeatureCollection","features":[{"id":0,"properties":{"cellId":1},"geometry":{"type":"Polygon","coordinates":[[[9.0,45.0],[9.1,45.0],[9.1,45.1],[9.0,45.1],[9.0,45.0]]]}}]}')
    got = activity.read_grid_geometry(spark, str(tmp_path / "g.geojson")).first()
    assert got.grid_id == 1 and len(got.ring) == 5 and '"Polygon"' in got.geometry_json


def test_stream_equals_batch(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / name(1)).write_text("\n".join([HEAD, *(row(h) for h in range(24))]) + "\n")
    stream = stream_hourly(read_activity_stream(spark, str(source)))
    query = stream.writeStream.outputMode("append").format("memory").queryName("hours").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination()
    closed = {r.timestamp: r.total_activity for r in spark.table("hours").collect()}
    batch = {r.timestamp: r.total_activity for r in hourly_grid_summary(clean(activity.read_activity(spark, str(source)).drop(activity.CORRUPT))).collect()}
    assert len(closed) >= 20 and all(batch[t] == x for t, x in closed.items())


def test_routing_after_a_failure_leaves_one_copy_of_each_file(spark, landing, tmp_path):
    zones = str(tmp_path / "yes"), str(tmp_path / "no"), str(tmp_path / "manifest")
    verdicts = gate.gate(spark, str(landing)).where("name < '" + name(7) + "'").coalesce(1).orderBy("name").cache()
    lost = verdicts.withColumn("path", F.when(F.col("name") == name(4), F.concat("path", F.lit("-lost"))).otherwise(F.col("path")))
    with pytest.raises(Exception, match="lost"):
        gate.route_once(lost, *zones, "run-1")
    told = gate.route_once(verdicts, *zones, "run-2")
    assert sorted((r.name, r.run) for r in told.collect()) == [(name(d), "run-2") for d in range(1, 7)]
    files = lambda z: sorted(f for f in os.listdir(z) if not f.endswith(".crc"))
    assert files(zones[0]) == [name(1)] and files(zones[1]) == [name(d) for d in range(2, 7)]
    (tmp_path / "yes" / name(1)).write_text("touched")
    again = gate.route_once(gate.gate(spark, str(landing)), *zones, "run-3")
    assert (tmp_path / "yes" / name(1)).read_text() == "touched"  # it was not copied again
    assert sorted(r.name for r in again.where("run = 'run-3'").collect()) == [name(d) for d in (7, 8, 9)] and len(files(zones[1])) == 8


def test_lines_are_judged_without_a_shuffle_or_sort_of_them(spark):
    from cellwatch.sources.gate import REQUIRED, headers_of, quality_of, raw_rows

    rows = [("a", ",".join(reversed(REQUIRED)), (0, 0)), ("a", '"4.5",,,1,,39,7,2020-01-01 00:00:00,more', (0, 1)), ("a", "0", (9, 0)), ("a", "x", (9, 1)), ("b", ",".join(REQUIRED), (0, 7)), ("b", "2020-01-01 05:00:00,3,39", (0, 9))]
    lines = spark.createDataFrame(rows, "name string, value string, place struct<block:bigint,id:bigint>")
    verdicts = spark.createDataFrame([("b", "accepted"), ("a", "rejected")], "name string, status string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as where lines are many
    try:
        headers = headers_of(lines, lines.select("name").distinct())
        made = headers, quality_of(lines, headers), raw_rows(lines, headers, verdicts)
        for df in made:
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "BroadcastHashJoin" in plan and "min_by" not in plan and "min(place" not in plan
        assert sorted(map(tuple, made[1].collect())) == [("a", 3, 1, "invalid timestamp: "), ("b", 1, 0, None)]
        assert [tuple(r) for r in made[2].collect()] == [("2020-01-01 05:00:00", 3, 39, None, None, None, None, None)]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
