"""Exact percentiles, the fitted model and scores against numpy, guards, and the writers that no query covers."""

import datetime as dt
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwatch.functions.expressions import FEATURES, MEASURES
from cellwatch.operators import aggregate, clean, risk, warehouse
from cellwatch.operators.percentiles import exact_percentiles
from cellwatch.sources import activity
from cellwatch.sources.versions import read_table
from cellwatch.streaming.hourly import publish_stream

T0 = dt.datetime(2020, 1, 1)


@pytest.mark.parametrize("size", [500, 40_000])  # below and above the size from which ranks are bracketed
@pytest.mark.parametrize("share", [0.0, 0.0005, 0.1, 0.5, 0.9, 1.0])
def test_percentiles_equal_numpy(spark, share, size):
    rng = np.random.default_rng(7)
    a, b = rng.lognormal(size=10 * (size // 10)), np.repeat([3.0, 1.0, 2.0], [size * 8 // 10, size // 10, size // 10])  # b: ties that fill whole brackets
    rows = [(float(x), float(y), None) for x, y in zip(a, b)] + [(None, None, None)] * 10
    df = spark.createDataFrame(rows, "a double, b double, c double").repartition(7)
    got = exact_percentiles(df, ["a", "b", "c"], share).collect()
    assert len(got) == 1 and got[0].c is None
    assert got[0].a == pytest.approx(np.quantile(a, share), rel=1e-12) and got[0].b == pytest.approx(np.quantile(b, share), rel=1e-12)


def test_percentiles_of_few_rows(spark):
    empty = spark.createDataFrame([], "a double")
    assert [r.a for r in exact_percentiles(empty, ["a"], 0.5).collect()] == [None]
    one = spark.createDataFrame([(4.0,)], "a double")
    assert [r.a for r in exact_percentiles(one, ["a"], 0.9).collect()] == [4.0]


@pytest.fixture(scope="module")
def training(spark):
    rng = np.random.default_rng(3)
    x = np.abs(rng.normal(size=(300, 6))) * [200, 0.5, 6, 1, 0.3, 0.2] + [100, 0, 10, 1, 0.1, 0.1]
    y = (x[:, 0] + 100 * rng.normal(size=300) > 300).astype(int)
    rows = [tuple(map(float, r)) + (int(l),) for r, l in zip(x, y)]
    rows[5] = (None,) + rows[5][1:]
    return spark.createDataFrame(rows, ", ".join(f"{f} double" for f in FEATURES) + ", label int"), rows


def _filled(rows):
    x = np.array([[np.nan if v is None else v for v in r[:6]] for r in rows])
    return np.where(np.isnan(x), np.nanmedian(x, axis=0), x)


def _scaled(rows):
    x = _filled(rows)
    return (x - x.mean(axis=0)) / x.std(axis=0)


def test_model_is_the_optimum_of_its_loss(spark, training):
    df, rows = training
    model = risk.fit_risk_model(df, c=1.0)
    x, y = _scaled(rows), np.array([r[6] for r in rows])
    w, b = np.array(model.weights), model.intercept
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-8 and abs((p - y).sum()) < 1e-8  # gradient of the summed loss with its penalty
    assert all(abs(r.gradient) < 1e-8 for r in risk.loss_gradient(df, model).collect())
    again = risk.fit_risk_model(df.repartition(13), c=1.0)
    assert np.allclose(again.weights, w, atol=1e-9) and abs(again.intercept - b) < 1e-9
    with pytest.raises(ValueError):
        risk.fit_risk_model(df.where("label = 1"))
    with pytest.raises(ValueError):
        risk.fit_risk_model(df.limit(0))
    told = risk.coefficients(spark, model).collect()
    assert [r.feature for r in told] == [FEATURES[i] for i in np.argsort(-np.abs(w), kind="stable")]
    given = df.drop("label").withColumn("row", F.monotonically_increasing_id())
    bad = given.limit(1).withColumn("internet_share", F.lit(2.0))
    scored = risk.score(given.where(" AND ".join(f"{f} IS NOT NULL" for f in FEATURES) + " AND internet_share <= 1").unionByName(bad), model, "v1").collect()
    assert sum(not r.valid for r in scored) == 1 and all((r.risk_score is None) == (not r.valid) for r in scored)
    filled = _filled(rows)
    mean, std = filled.mean(axis=0), filled.std(axis=0)
    for r in (r for r in scored if r.valid):
        z = (np.array([r[f] for f in FEATURES]) - mean) / std @ w + b
        assert r.risk_score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-9)
        assert r.risk_level == ("high" if r.risk_score >= 0.7 else "medium" if r.risk_score >= 0.3 else "low") and "v1" in r.reason


def test_guards(spark):
    dim = spark.createDataFrame([(1,), (2,)], "grid_id int")
    assert clean.require_grid(dim, 2).count() == 1
    for bad, kind in ((0, ValueError), (10001, ValueError), (77, LookupError)):
        with pytest.raises(kind):
            clean.require_grid(dim, bad)
    rows = spark.createDataFrame([(1, T0), (2, T0)], "grid_id int, timestamp timestamp")
    assert aggregate.require_unique_grain(rows).count() == 2
    with pytest.raises(ValueError):
        aggregate.require_unique_grain(rows.union(rows.limit(1)))


def test_timestamps_return_from_keys(spark):
    zeros = {m: F.lit(0.0) for m in (*MEASURES, "total_sms", "total_calls")}
    rows = spark.createDataFrame([(1, T0, 1.0), (1, T0 + dt.timedelta(hours=5), 2.0)], "grid_id int, timestamp timestamp, total_activity double").withColumns(zeros)
    rows = rows.withColumns({"date": F.date_format("timestamp", "yyyy-MM-dd"), "hour": F.hour("timestamp")})
    fact, dim = warehouse.build_fact(rows), warehouse.build_dim_time(rows)
    want = sorted(r.timestamp for r in rows.collect())
    assert sorted(r.timestamp for r in warehouse.with_timestamp(fact.drop("timestamp"), dim).collect()) == want
    assert sorted(r.timestamp for r in warehouse.with_timestamp(fact).collect()) == want


def test_small_writers(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "n int, s string").repartition(2)
    activity.write_report(df, str(tmp_path / "report"))
    assert spark.read.option("header", True).csv(str(tmp_path / "report")).count() == 2 and len(list((tmp_path / "report").glob("*.csv"))) == 1
    activity.write_run_metrics(df, str(tmp_path / "metrics"))
    assert sorted(json.loads(x)["n"] for p in (tmp_path / "metrics").glob("*.json") for x in p.read_text().splitlines()) == [1, 2]
    for day in ("2020-01-01", "2020-01-02"):
        df.write.parquet(str(tmp_path / day))
    both = activity.union_partitions(spark, {d: str(tmp_path / d) for d in ("2020-01-01", "2020-01-02")})
    assert sorted(map(tuple, both.groupBy("date").count().collect())) == [("2020-01-01", 2), ("2020-01-02", 2)]
    with pytest.raises(ValueError):
        activity.union_partitions(spark, {})


def test_published_stream_can_run_again(spark, tmp_path):
    schema = "grid_id int, timestamp timestamp, total_activity double, date string"
    source = str(tmp_path / "in")
    spark.createDataFrame([(1, T0, 1.0, "2020-01-01"), (2, T0, 2.0, "2020-01-01")], schema).write.parquet(source)
    for turn in range(2):  # a new checkpoint makes the same batch come again
        stream = spark.readStream.schema(schema).parquet(source)
        publish_stream(stream, str(tmp_path / "fact"), str(tmp_path / f"checkpoint{turn}")).trigger(availableNow=True).start().awaitTermination()
        assert sorted((r.grid_id, r.total_activity) for r in read_table(spark, str(tmp_path / "fact")).collect()) == [(1, 1.0), (2, 2.0)]


def test_scoring_queries_work_out_the_fact_once(spark, sf_dir, monkeypatch):
    from cellwatch.plans import model, signals

    calls, real = [], model.hourly
    for where in (model, signals):
        monkeypatch.setattr(where, "hourly", lambda s, sf: calls.append(sf) or real(s, sf))
    assert model.QUERIES["score_latest"](spark, sf_dir.replace("sf0.001", "sf0.01")).count() == 1 and len(calls) == 1
