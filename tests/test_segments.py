"""Windows by chunks against plain windows over whole histories."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window, functions as F

from cellwatch.operators import baselines, features, segments

T0 = dt.datetime(2019, 12, 30, 5)


@pytest.fixture(scope="module")
def history(spark):
    """One busy cell, one with gaps of hours to months, one of flat values, one of a single hour."""
    random.seed(5)
    rows = [(1, h) for h in range(900)] + [(3, h) for h in range(0, 300)] + [(4, 17)]
    at = 0
    for _ in range(150):
        at += random.choice([1, 1, 1, 2, 5, 23, 24, 25, 47, 48, 49, 170, 1500])
        rows.append((2, at))
    rows = [(g, T0 + dt.timedelta(hours=h), "50.00" if g == 3 else f"{random.randint(0, 10**6) / 100:.2f}", None if h % 31 == 0 else "1.25") for g, h in rows]
    df = spark.createDataFrame(rows, "grid_id int, timestamp timestamp, x string, y string")
    return df.select("grid_id", "timestamp", F.col("x").cast("decimal(18,2)").alias("total_activity"), F.col("y").cast("decimal(18,2)").alias("internet_activity")).cache()


def rows_of(df):
    return sorted(map(str, df.select(*sorted(df.columns)).collect()))


@pytest.mark.parametrize("hours", [1, 7, 48, 336, 10**6])
def test_features_and_scores_do_not_depend_on_chunks(history, hours):
    whole = 10**7  # one chunk
    assert rows_of(features.build_features(history, chunk_hours=hours)) == rows_of(features.build_features(history, chunk_hours=whole))
    assert rows_of(baselines.expanding_zscores(history, chunk_hours=hours)) == rows_of(baselines.expanding_zscores(history, chunk_hours=whole))


def test_expanding_sums_equal_a_plain_window(history):
    w = Window.partitionBy("grid_id").orderBy("timestamp")
    got = segments.expanding_sums(history, {"s": F.col("total_activity"), "n": F.lit(1)}, hours=24)
    past = w.rowsBetween(Window.unboundedPreceding, -1)
    want = history.withColumns({"s": F.coalesce(F.sum("total_activity").over(past), F.lit(0).cast("decimal(28,2)")), "n": F.coalesce(F.sum(F.lit(1)).over(past), F.lit(0))})
    assert rows_of(got) == rows_of(want)
    before = segments.previous_value(history, "total_activity", hours=24)
    assert rows_of(before) == rows_of(history.withColumn("previous", F.lag("total_activity").over(w)))


def test_no_window_sees_a_whole_history(history):
    """A window's partition holds a chunk and its halo; whole keys meet only as one row for each chunk."""
    chunked = segments.with_halo(history, 47, hours=48).groupBy("grid_id", "chunk").count()
    assert chunked.agg(F.max("count")).first()[0] <= 48 + 47
    plan = features.build_features(history)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(grid_id#" in plan and all("chunk#" in line for line in plan.splitlines() if line.strip(" :+-").startswith("Window "))


def test_empty_histories(history):
    none = history.limit(0)
    assert features.build_features(none).count() == 0 and baselines.expanding_zscores(none).count() == 0 and segments.previous_value(none, "total_activity").count() == 0
