"""Hand-computed cases of the activity operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellwatch.functions.expressions import MEASURES
from cellwatch.operators import aggregate, baselines, clean, compare, evidence, features, geo, profile, quality, risk, serving, signals, warehouse

T0 = dt.datetime(2020, 1, 1)
SPIKE_END = dt.datetime(2020, 3, 3, 23)


@pytest.fixture(scope="module")
def star(spark):
    values = {101: [10, 50, 20, 5], 202: [3, 3, 3, 3], 303: [0, 1, 1, 1]}
    times = [T0, T0 + dt.timedelta(hours=1), T0 + dt.timedelta(days=1), T0 + dt.timedelta(days=1, hours=1)]
    return spark.createDataFrame([(g, t, float(x)) for g, xs in values.items() for t, x in zip(times, xs)], "grid_id int, timestamp timestamp, total_activity double")


@pytest.fixture(scope="module")
def spike(spark):
    v = [-6, -3, 0, 3, 6, 3, 0, -3] * 3
    rows = []
    for i in range(72):
        t = dt.datetime(2020, 3, 1) + dt.timedelta(hours=i)
        rows += [(4821, t, 5000.0 if i == 71 else 100.0 + v[i % 24]), (707, t, 50.0)]
    df = spark.createDataFrame(rows, "grid_id int, timestamp timestamp, total_activity double")
    zero = F.lit(0.0)
    return df.withColumns({m: zero for m in MEASURES[:4]} | {"internet_activity": F.col("total_activity"), "total_sms": zero, "total_calls": zero, "date": F.date_format("timestamp", "yyyy-MM-dd"), "hour": F.hour("timestamp")})


def test_cleaning_counts_every_row(spark):
    schema = "datetime string, CellID int, countrycode int, smsin double, smsout double, callin double, callout double, internet double"
    t = "2020-01-01 00:00:00"
    raw = spark.createDataFrame(
        [(t, None, 39, 1.0, None, None, None, None), ("NOT-A-DATE", 1, 39, 1.0, None, None, None, None), (t, 1, 39, -1.0, None, None, None, None), (t, 1, 39, None, None, None, None, None), (t, 2, 39, 1.0, 2.0, 3.0, 4.0, 5.0)],
        schema,
    )
    told = clean.clean_metrics(raw).first()
    assert (told.input_rows, told.rejected_ids, told.rejected_negative, told.output_rows, told.nulls_handled, told.balanced) == (5, 2, 1, 2, 5, True)
    rows = {r.grid_id: r for r in aggregate.hourly_grid_summary(clean.clean(raw)).collect()}
    assert rows[1].total_activity == 0.0 and rows[2].total_activity == 15.0


def test_required_columns_are_named(spark):
    with pytest.raises(ValueError, match="internet"):
        clean.canonicalize(spark.createDataFrame([("x", 1)], "datetime string, CellID int"))


def test_network_summary(star):
    last = serving.network_summary(star).first()
    assert (last.total_activity, last.active_grids, last.peak_hour, last.top_grid) == (100.0, 3, 1, 101)
    first = serving.network_summary(star, "2020-01-01 01:00:00").first()
    assert (first.total_activity, first.active_grids, first.peak_hour, first.top_grid) == (67.0, 3, 1, 101)


def test_unknown_as_of_is_an_error(star):
    assert baselines.resolve_as_of(star) == T0 + dt.timedelta(days=1, hours=1)
    with pytest.raises(LookupError):
        baselines.resolve_as_of(star, "2021-01-01 00:00:00")
    with pytest.raises(LookupError):
        baselines.resolve_as_of(star.limit(0))


def test_hotspots_and_alerts(spike):
    top = signals.hotspots(spike).collect()
    assert (top[0].grid_id, top[0].total_activity, top[0].status, top[0].rank) == (4821, 5000.0, "elevated", 1)
    assert signals.hotspots(spike, status="other").count() == 0
    found = signals.alerts(spike).collect()
    assert [(a.grid_id, a.severity) for a in found] == [(4821, "high")]
    assert abs(found[0].baseline - 100) < 0.2 and 3 < found[0].std < 5
    with pytest.raises(ValueError):
        signals.hotspots(spike, n=0)


def test_grid_series(spike):
    trailing = serving.grid_activity(spike, 4821).collect()
    assert len(trailing) == 24 and trailing[-1].total_activity == 5000.0
    assert serving.grid_activity(spike, 4821, date="2020-03-02").count() == 24
    assert serving.grid_activity(spike, 4821, date="2020-03-02", hour=5).count() == 1
    assert serving.grid_activity(spike, 4821, hour=5).count() == 3


def test_feature_age(spark, spike):
    stored = spark.createDataFrame([(4821, SPIKE_END), (707, SPIKE_END - dt.timedelta(hours=24))], "grid_id int, feature_timestamp timestamp")
    ages = {r.grid_id: r.feature_age_hours for r in serving.serve_features(stored, spike).collect()}
    assert ages == {4821: 0.0, 707: 24.0}
    with pytest.raises(LookupError):
        serving.serve_features(stored, spike, 555)


def test_features_need_whole_windows(spark, spike):
    rows = {(r.grid_id, r.feature_timestamp): r for r in features.build_features(spike).collect()}
    last = rows[4821, SPIKE_END]
    assert last.data_quality_status == "ok" and last.row_count == 24 and last.internet_share == 1.0
    assert rows[707, SPIKE_END].variability == 0.0 and rows[707, SPIKE_END].activity_growth == 0.0
    gap = spike.where(F.col("timestamp") != F.lit("2020-03-03 05:00:00").cast("timestamp"))
    short = features.build_features(gap).where(F.col("feature_timestamp") == F.lit(SPIKE_END)).first()
    assert short.data_quality_status == "insufficient_data" and short.row_count == 23
    silent = features.latest_per_grid(features.build_features(spike.withColumns({"total_activity": F.lit(0.0), "internet_activity": F.lit(0.0)}))).first()
    assert silent.active_hours == 0 and silent.peak_ratio is None and silent.internet_share is None
    labels = features.next_hour_labels(features.build_features(gap), gap)
    assert labels.where(F.col("feature_timestamp") == F.lit("2020-03-03 04:00:00").cast("timestamp")).count() == 0


def test_leakage_is_found(spike):
    sound = features.leakage_violations(spike).first()
    assert (sound.later_rows, sound.too_early_rows) == (0, 0)
    broken = features.leakage_violations(spike, features._by_time().rangeBetween(-23 * 3600, 3600)).first()
    assert broken.later_rows > 0


def test_same_hour_anomaly(spark):
    values = [410.7693, 382.4848, 425.1315, 422.4134, 421.0265, 447.7334, 1265.9122]
    rows = [(6477, dt.datetime(2013, 11, 1 + i, 23), x) for i, x in enumerate(values)]
    a = signals.anomaly_scores(spark.createDataFrame(rows, "grid_id int, timestamp timestamp, total_activity double")).first()
    assert round(a.baseline, 4) == 418.2598 and round(a["std"], 4) == 19.4798 and round(a.anomaly_score, 4) == 43.5144
    assert a.direction == "high" and a.is_anomaly and a.n == 6


def test_direction_is_the_sign_of_the_score(spark):
    rows = [(g, dt.datetime(2013, 11, 1 + i, 23), x) for g, last in ((1, 101.0), (2, 99.0), (3, 100.0), (4, 200.0)) for i, x in enumerate([95.0, 105.0, last])]
    scores = signals.anomaly_scores(spark.createDataFrame(rows, "grid_id int, timestamp timestamp, total_activity double"))
    got = {r.grid_id: (r.direction, r.is_anomaly) for r in scores.collect()}
    assert got == {1: ("high", False), 2: ("low", False), 3: ("normal", False), 4: ("high", True)}
    told = signals.anomaly_summary(scores).first()
    assert (told.scored, told.high, told.low) == (4, 1, 0)
    fact = spark.createDataFrame([(g, dt.datetime(2013, 11, 4, 0), 1.0) for g in (1, 2, 4)], "grid_id int, timestamp timestamp, total_activity double")
    risk = fact.select("grid_id", "timestamp", F.lit("low").alias("risk_level"))
    by = {r.grid_id: (r.anomalies, r.high_anomalies, r.low_anomalies) for r in evidence.historical_evidence(fact, scores, risk, "2013-11-05 00:00:00").collect()}
    assert by == {1: (0, 0, 0), 2: (0, 0, 0), 4: (1, 1, 0)}


def test_within_day_rules(spark):
    xs = [10.0, 10.0, 10.0, 40.0, 10.0, 1.0]
    rows = [(1, T0 + dt.timedelta(hours=i), x, "2020-01-01") for i, x in enumerate(xs)]
    found = signals.within_day_alerts(spark.createDataFrame(rows, "grid_id int, timestamp timestamp, total_activity double, date string")).collect()
    assert sorted((r.timestamp.hour, r.alert_type) for r in found) == [(3, "ACTIVITY_SPIKE"), (3, "HIGH_ACTIVITY"), (5, "ACTIVITY_DROP")]


def test_upsert_is_idempotent(star):
    new = star.where("grid_id = 101").withColumn("total_activity", F.lit(1.0))
    once = warehouse.upsert(star, new)
    assert once.count() == 12 and warehouse.upsert(once, new).agg(F.sum("total_activity")).first()[0] == 4 + 12 + 3
    assert warehouse.publication_summary(star, new).first().warehouse_rows == 12


def test_scoring_contract(spark, tmp_path):
    schema = "grid_id int, feature_timestamp timestamp, avg_activity double, activity_growth double, active_hours int, peak_ratio double, variability double, internet_share double, data_quality_status string"
    rows = [(1, T0, 100.0, 0.1, 24, 1.5, 0.2, 0.7, "ok"), (2, T0, 500.0, 0.4, 24, 2.2, 0.5, 0.9, "ok"), (3, T0, 300.0, 0.2, 23, 1.8, 0.3, 0.8, "insufficient_data")]
    table = spark.createDataFrame(rows, schema)
    train = spark.createDataFrame([(50.0, 0.0, 24, 1.2, 0.1, 0.5, 0), (100.0, 0.1, 24, 1.5, 0.2, 0.6, 0), (500.0, 0.4, 24, 2.2, 0.5, 0.9, 1), (700.0, 0.6, 24, 2.8, 0.7, 0.95, 1)], "avg_activity double, activity_growth double, active_hours int, peak_ratio double, variability double, internet_share double, label int")
    model = risk.fit_risk_model(train)
    risk.save_model(model, str(tmp_path / "m"), "v1", 300.0)
    loaded, told = risk.load_model(spark, str(tmp_path / "m"))
    scored = {r.grid_id: r for r in risk.score_latest(table, loaded, told["version"]).collect()}
    assert set(scored) == {1, 2} and scored[2].risk_score > scored[1].risk_score and scored[1].model_version == "v1"
    report = signals.attention_report(risk.score_latest(table, loaded, "v1")).first()
    assert report.grid_id == 2 and "attention" in report.note and "investigate" in report.note
    with pytest.raises(LookupError):
        risk.score_latest(table.where("grid_id = 3"), loaded, "v1")
    bad = clean.validate_features(table.withColumn("internet_share", F.lit(1.2))).first()
    assert not bad.valid and bad.violations == ["internet_share above 1"]


def test_health_reasons(spark, spike):
    schema = "run_id string, per_task_status map<string,string>, rows_published bigint, as_of timestamp"
    runs = spark.createDataFrame(
        [("ok", {"a": "success"}, 144, SPIKE_END), ("failed", {"a": "success", "quality_check": "failed"}, 144, SPIKE_END), ("stale", {"a": "success"}, 144, SPIKE_END - dt.timedelta(days=1))], schema
    )
    told = {r.run_id: r for r in quality.pipeline_health(runs, spike).collect()}
    assert told["ok"].healthy and told["ok"].reasons == []
    assert any("quality_check" in r for r in told["failed"].reasons) and not told["failed"].healthy
    assert told["stale"].freshness_hours == 24.0 and not told["stale"].healthy


def test_geometry(spark):
    from cellwatch.adapters import square_cells

    cells = square_cells(spark, 300)
    assert geo.check_geometry_keys(cells, 1, 300).first().sound
    assert geo.check_adjacency(geo.build_dim_grid(cells)).count() == 0
    shifted = cells.withColumn("grid_id", F.col("grid_id") - 1)  # keyed by the 0-based id
    assert not geo.check_geometry_keys(shifted, 1, 300).first().sound
    assert geo.check_adjacency(geo.build_dim_grid(shifted)).count() > 0


def test_guarded_metrics(spark):
    none = compare.classification_metrics(spark.createDataFrame([(0, 0)], "label int, predicted int")).first()
    assert (none.precision, none.recall, none.accuracy) == (0.0, 0.0, 1.0)


def test_evidence_counts(spike):
    recent = {r.grid_id: r for r in evidence.recent_history(spike).collect()}
    assert recent[707].intervals == 24 and recent[707].mean_activity == 50.0
    none = spike.select("grid_id", "timestamp", F.lit(False).alias("is_anomaly"), F.lit("normal").alias("direction"))
    risks = spike.select("grid_id", "timestamp", F.lit("low").alias("risk_level"))
    told = {r.grid_id: r for r in evidence.historical_evidence(spike, none, risks).collect()}
    assert told[4821].activity_rows == 71 and told[4821].low_risks == 71 and told[4821].anomaly_available and told[4821].anomalies == 0


def test_cadence_finds_gaps(spike):
    assert profile.cadence(spike).first().hourly
    assert not profile.cadence(spike.where("hour <> 5")).first().hourly


def test_reports_avoid_a_loaded_word(spike):
    for df in (signals.hotspots(spike), signals.alerts(spike), signals.anomaly_scores(spike)):
        assert all("congestion" not in r.reason.lower() for r in df.collect())


def test_context_sizes(spark):
    full = spark.createDataFrame([(1, "x" * 40), (2, "x" * 10)], "grid_id int, context_json string")
    curated = spark.createDataFrame([(1, "x" * 10), (3, "x")], "grid_id int, context_json string")
    assert [tuple(r) for r in evidence.context_sizes(full, curated).collect()] == [(1, 40, 10, 0.75)]
