"""Every registered query of the activity layer against its SQL, on the smallest tables."""

import math

import duckdb
import pytest

from cellwatch.queries import ORACLES, QUERIES


#: No hour of the smallest tables has two days of history, and a fit without rows is an error.
NEED_ROWS = {"fit_risk_model", "save_model", "loss_gradient", "score", "score_latest"}


def tables(folder):
    con = duckdb.connect()
    for name in ("events", "documents"):
        con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def told(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "null"
    return repr(float(v)) if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, sf_dir, name):
    folder = sf_dir.replace("sf0.001", "sf0.01") if name in NEED_ROWS else sf_dir
    got = QUERIES[name](spark, folder)
    columns = sorted(got.columns)
    want = tables(folder).sql(ORACLES[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    ours = sorted(tuple(told(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(told(r[i]) for i in order) for r in want.fetchall())
    assert ours == theirs


def test_hotspots_plan_pushes_and_prunes(spark, sf_dir):
    plan = QUERIES["hotspots"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "TakeOrderedAndProject" in plan and "CartesianProduct" not in plan
