"""Tables that change at one instant, and digests of their content."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cellwatch.sources import activity
from cellwatch.sources.content import content_differences, content_digest
from cellwatch.sources.versions import ConflictError, VersionedTable, read_table

SCHEMA = "grid_id int, timestamp timestamp, x double, date string"


def fact(spark, n_days, x, start=1):
    rows = [(g, dt.datetime(2020, 1, d, h), x + g, f"2020-01-{d:02d}") for d in range(start, start + n_days) for h in range(4) for g in (1, 2)]
    return spark.createDataFrame(rows, SCHEMA)


def seen(spark, path):
    return sorted(map(tuple, read_table(spark, path).select("grid_id", "timestamp", "x", "date").collect()))


class Stop(Exception):
    pass


@pytest.mark.parametrize("step", ["write", "_claim", "_rename"])
@pytest.mark.parametrize("change", ["publish", "refresh", "replace_snapshot"])
def test_a_stop_between_steps_leaves_the_last_version_whole(spark, tmp_path, monkeypatch, change, step):
    path = str(tmp_path / "t")
    does = {"publish": lambda df: activity.publish(path, df), "refresh": lambda df: activity.refresh(df, path), "replace_snapshot": lambda df: activity.replace_snapshot(df, path)}[change]
    does(fact(spark, 3, 0.0))
    old = seen(spark, path)
    whole = getattr(VersionedTable, step)

    def stops(self, *args):
        if step == "write":
            whole(self, *args)  # all rows are there, and no manifest
        raise Stop

    with monkeypatch.context() as m:
        m.setattr(VersionedTable, step, stops)
        with pytest.raises(Stop):
            does(fact(spark, 1, 100.0, start=2))
    assert seen(spark, path) == old
    does(fact(spark, 1, 100.0, start=2))  # the same job again
    new = [r for r in old if r[3] != "2020-01-02"] if change != "refresh" else []
    assert seen(spark, path) == sorted(new + [tuple(r) for r in fact(spark, 1, 100.0, start=2).collect()])
    does(fact(spark, 1, 100.0, start=2))
    assert len(seen(spark, path)) == len(new) + 8


def test_readers_keep_their_version_and_writers_do_not_meet(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ("date",))
    with pytest.raises(FileNotFoundError):
        table.read()
    assert table.commit(fact(spark, 2, 0.0)) == 1
    before = table.read()
    other = VersionedTable(spark, str(tmp_path / "t"), ("date",))
    whole = other.manifest
    late = {"told": whole()}
    assert table.commit(fact(spark, 1, 5.0), keep_others=True) == 2
    other.manifest = lambda version=None: late["told"]  # it read before the commit
    with pytest.raises(ConflictError):
        other.commit(fact(spark, 1, 9.0))
    assert before.agg(F.max("x")).first()[0] == 2.0 and table.read().agg(F.max("x")).first()[0] == 7.0 and table.read(1).count() == 16
    assert table.vacuum(keep=1) == 2 and table.versions() == [2] and table.read().count() == 16
    table.commit(fact(spark, 1, 0.0).limit(0))
    assert table.read().count() == 0 and table.read().schema == fact(spark, 1, 0.0).schema


def test_one_changed_cell_is_found_and_named(spark, tmp_path):
    df = fact(spark, 3, 0.0)
    damaged = df.withColumn("x", F.when((F.col("grid_id") == 2) & (F.col("timestamp") == F.lit("2020-01-02 03:00:00").cast("timestamp")), F.col("x") + 1e-9).otherwise(F.col("x")))
    path = str(tmp_path / "t")
    typed = lambda x: x.withColumn("date", F.to_date("date"))
    activity.write_processed(df.repartition(3, "x"), path)
    told = activity.verify_roundtrip(typed(df), path).first()
    assert told.sound and told.written_rows == told.read_rows == 24 and told.changed == []
    activity.write_processed(damaged, path)
    told = activity.verify_roundtrip(typed(df), path).first()
    assert not told.sound and told.changed == ["2020-01-02"] and told.written_rows == told.read_rows
    assert not activity.verify_roundtrip(typed(df).drop("x"), path).first().sound


def test_digests_count_repeated_rows_and_tell_nulls_apart(spark):
    rows = lambda *r: spark.createDataFrame(list(r), "date string, a bigint, b bigint")
    same = lambda p, q: [r.same for r in content_differences(p, q).orderBy("date").collect()]
    assert same(rows(("d", 1, 2), ("d", 1, 2)), rows(("d", 1, 2))) == [False]
    assert same(rows(("d", None, 2)), rows(("d", 2, None))) == [False]
    assert same(rows(("d", 1, 2), ("d", 3, 4), (None, 1, 1)), rows((None, 1, 1), ("d", 3, 4), ("d", 1, 2))) == [True, True]
    assert same(rows(("d", 1, 2)), rows(("e", 1, 2))) == [False, False]
    assert content_digest(rows(("d", 1, 1)).limit(0)).count() == 0
    with pytest.raises(ValueError):
        content_differences(rows(("d", 1, 1)), rows(("d", 1, 1)).drop("b"))


def test_compaction_keeps_rows_and_meets_the_target(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ("date",))
    df = fact(spark, 3, 0.0).unionByName(fact(spark, 1, 0.0).withColumn("date", F.lit(None).cast("string")))
    table.commit(df.repartition(6))
    before = {r.part: r.files for r in table.layout().collect()}
    assert len(before) == 4 and max(before.values()) > 1
    rows = sorted(map(str, table.read().collect()))
    assert table.compact() == 2 and table.compact() is None
    assert {r.files for r in table.layout().collect()} == {1} and sorted(map(str, table.read().collect())) == rows
    one = VersionedTable(spark, str(tmp_path / "u"))
    one.commit(spark.range(20000).repartition(9))
    size = one.layout().first().bytes
    assert one.compact(size // 3) == 2
    got = one.layout().first()
    assert 2 <= got.files <= 4 and one.read().count() == 20000 and one.read().agg(F.countDistinct("id")).first()[0] == 20000


def test_each_share_of_a_compaction_is_a_file(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ("date",))
    table.commit(spark.range(24000).withColumn("date", (F.col("id") % 12).cast("string")).repartition(9))
    target = table.layout().agg(F.max("bytes")).first()[0] // 3 + 1
    need = {r.part: -(-r.bytes // target) for r in table.layout().collect()}
    assert min(need.values()) > 1 and table.compact(target) == 2
    assert {r.part: r.files for r in table.layout().collect()} == need and table.read().count() == 24000
