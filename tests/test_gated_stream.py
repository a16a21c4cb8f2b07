"""The gate on a stream: bad files and repeated names leave the fact as it is, also when the job stops halfway."""

import pytest

from cellwatch.sources.versions import VersionedTable, read_table
from cellwatch.streaming import gated

HEAD = "datetime,CellID,countrycode,smsin,smsout,callin,callout,internet"


def put(folder, day, lines, head=HEAD):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / f"sms-call-internet-mi-2020-01-{day:02d}.csv").write_text("\n".join([head, *lines]) + "\n")


def row(day, hour, net="10.5", cell=1):
    return f"2020-01-{day:02d} {hour:02d}:00:00,{cell},39,1.0,0.5,,0.25,{net}"


@pytest.fixture
def run(spark, tmp_path):
    def go():
        stream = gated.read_lines_stream(spark, str(tmp_path / "in"))
        gated.publish_gated_stream(stream, str(tmp_path / "fact"), str(tmp_path / "audit"), str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()

    return go


def facts(spark, tmp_path):
    return sorted((r.grid_id, str(r.timestamp), r.total_activity) for r in read_table(spark, str(tmp_path / "fact")).collect())


def audit(spark, tmp_path):
    return sorted((r.name[-6:-4], r.status) for r in read_table(spark, str(tmp_path / "audit")).collect())


def test_bad_and_repeated_files_leave_the_fact(spark, tmp_path, run):
    put(tmp_path / "in", 1, [row(1, h) for h in range(3)] + [row(1, 0)])
    put(tmp_path / "in", 2, [row(2, 0), row(2, 1, net="abc")])
    put(tmp_path / "in", 3, [row(3, 0).rpartition(",")[0]], HEAD.removesuffix(",internet"))
    columns = HEAD.split(",")
    put(tmp_path / "in", 4, [",".join(reversed(row(4, 5).split(",")))], ",".join(reversed(columns)))
    run()
    first = facts(spark, tmp_path)
    assert first == [(1, "2020-01-01 00:00:00", 24.5), (1, "2020-01-01 01:00:00", 12.25), (1, "2020-01-01 02:00:00", 12.25), (1, "2020-01-04 05:00:00", 12.25)]
    assert audit(spark, tmp_path) == [("01", "accepted"), ("02", "rejected"), ("03", "rejected"), ("04", "accepted")]
    put(tmp_path / "in" / "later", 1, [row(1, 0, net="999")])  # an accepted name with other rows
    put(tmp_path / "in" / "later", 5, [row(5, 0, net="-1")])
    run()
    assert facts(spark, tmp_path) == first
    put(tmp_path / "in" / "mended", 2, [row(2, 0)])  # a rejected name may come again
    put(tmp_path / "in" / "mended2", 2, [row(2, 0, net="7777")])  # twice in one batch: the first path counts
    run()
    assert facts(spark, tmp_path) == sorted([*first, (1, "2020-01-02 00:00:00", 12.25)])
    assert audit(spark, tmp_path)[-1] == ("05", "rejected") and audit(spark, tmp_path).count(("02", "skipped_duplicate")) == 1


@pytest.mark.parametrize("step", ["before the fact", "before the audit", "after the audit"])
def test_a_batch_that_comes_again_changes_nothing(spark, tmp_path, monkeypatch, step):
    put(tmp_path / "in", 1, [row(1, h) for h in range(2)])
    schema = "path string, name string, block bigint, value string"
    lines = [HEAD, row(1, 0), row(1, 1)]
    batch = spark.createDataFrame([("in/x", "x.csv", 0, v) for v in lines], schema).coalesce(1)
    take = lambda: gated.take_batch(batch, 7, str(tmp_path / "fact"), str(tmp_path / "audit"))

    class Stop(Exception):
        pass

    def stop(*args, **more):
        raise Stop

    if step == "after the audit":
        take()
    else:
        with monkeypatch.context() as m:
            m.setattr(*((gated, "publish", stop) if step == "before the fact" else (VersionedTable, "commit", _only_fact(VersionedTable.commit, stop))))
            with pytest.raises(Stop):
                take()
    take()
    assert [x[2] for x in facts(spark, tmp_path)] == [12.25, 12.25]
    assert [(r.name, r.status) for r in read_table(spark, str(tmp_path / "audit")).collect()] == [("x.csv", "accepted")]


def _only_fact(commit, stop):
    return lambda self, df, keep_others=False: stop() if self.by == ("batch_id",) else commit(self, df, keep_others)
