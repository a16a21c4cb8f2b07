"""Stored sums, all instants at once, and leaks, against plain recomputation."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from cellwatch.operators import baselines, features, incremental, serving, signals
from cellwatch.sources.versions import VersionedTable, read_table

T0 = dt.datetime(2020, 1, 1)


def fact_of(spark, days, seed=1):
    random.seed(seed)
    rows = [(g, T0 + dt.timedelta(hours=h), f"{random.randint(0, 9999) / 100 if g != 3 else 0:.2f}", "0.25") for g in (1, 2, 3, 7) for h in range(0, 24 * days, 1 + g % 3) if random.random() < 0.8]
    df = spark.createDataFrame(rows, "grid_id int, timestamp timestamp, x string, y string")
    return df.select("grid_id", "timestamp", F.col("x").cast("decimal(18,2)").alias("total_activity"), F.col("y").cast("decimal(18,2)").alias("internet_activity"))


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.fixture(scope="module")
def fact(spark):
    return fact_of(spark, 75).cache()


@pytest.mark.parametrize("bucket", ["all_history", "hour_of_day"])
def test_stored_sums_give_the_full_recompute_after_late_corrections(spark, fact, tmp_path, bucket):
    path = str(tmp_path / "sums")
    incremental.update_statistics(spark, path, fact.where("timestamp < '2020-02-20'"))
    late = fact.where("timestamp BETWEEN '2020-01-03' AND '2020-01-09' AND grid_id = 2").withColumn("total_activity", (F.col("total_activity") * 2).cast("decimal(18,2)"))
    new = late.unionByName(fact.join(late, ["grid_id", "timestamp"], "left_anti"))
    for _ in range(2):
        incremental.update_statistics(spark, path, new, late.unionByName(fact.where("timestamp >= '2020-02-20'")))
    stored = read_table(spark, path)
    assert rows_of(stored) == rows_of(incremental.statistics(new))
    for at in (None, "2020-01-01 00:00:00", "2020-01-20 05:00:00", "2020-02-13 00:00:00", "2020-03-09 23:00:00"):
        assert rows_of(incremental.baselines_from(stored, new, at, bucket)) == rows_of(baselines.baselines(new, at, bucket)), at
    scores = signals.anomaly_scores(new, None, incremental.baselines_from(stored, new, None, "hour_of_day"))
    assert rows_of(scores) == rows_of(signals.anomaly_scores(new)) and VersionedTable(spark, path, ("period",)).versions() == [1, 2, 3]


def test_all_instants_at_once_equal_one_at_a_time(spark):
    fact = fact_of(spark, 4, seed=3).where("NOT (timestamp < '2020-01-01 05:00:00' AND grid_id = 1)")
    got = {r.as_of: tuple(r) for r in serving.network_history(fact).collect()}
    times = [r.timestamp for r in fact.select("timestamp").distinct().orderBy("timestamp").collect()]
    assert sorted(got) == times
    for at in times[:4] + times[10::9]:
        want = serving.network_summary(fact, str(at)).select("as_of", "total_activity", "active_grids", "peak_hour", "peak_hour_activity", "top_grid", "top_grid_activity").first()
        assert got[at] == tuple(want)
    assert serving.network_history(fact.limit(0)).count() == 0


def test_leaks_are_found_without_knowing_the_frame(fact):
    at = "2020-01-20 12:00:00"
    assert features.leakage_by_change(fact, features.build_features, at).first().changed == 0
    w = Window.partitionBy("grid_id").orderBy("timestamp")
    broken = {
        "next row": lambda df: df.select("grid_id", F.col("timestamp").alias("feature_timestamp"), F.lead("total_activity").over(w).alias("x")),
        "whole mean": lambda df: df.join(df.groupBy("grid_id").agg(F.avg("total_activity").alias("m")), "grid_id").select("grid_id", F.col("timestamp").alias("feature_timestamp"), "m"),
        "rows that come and go": lambda df: df.join(df.where("total_activity > 150").groupBy("grid_id").count(), "grid_id").select("grid_id", F.col("timestamp").alias("feature_timestamp"), F.lit(1).alias("x")),
    }
    for name, build in broken.items():
        assert features.leakage_by_change(fact, build, at).first().changed > 0, name
