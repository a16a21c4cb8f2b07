"""Queries on labels, models, comparison of signals, and run checks."""

from __future__ import annotations

from pyspark.sql import functions as F

from cellwatch.operators import baselines as bl, clean as cl, compare as cp, evidence as ev, features as ft, quality as ql, risk as rk, signals as sg, warehouse as wh
from cellwatch.functions.expressions import FEATURES
from cellwatch.plans.common import WITH, hourly, plain, raw, t
from cellwatch.sources.versions import work_folder
from cellwatch.plans.signals import _ANOM, _FEAT, _dim, _features, _anomalies

def _stored(s, sf):
    """The fact and its features, each worked out once and written, for queries that look at them many times."""
    path = work_folder(s, "features")

    def keep(df, name):
        df.write.parquet(f"{path}/{name}")
        return s.read.schema(df.schema).parquet(f"{path}/{name}")

    h = keep(hourly(s, sf), "fact")
    return h, keep(ft.build_features(h), "features")


def _labelled(s, sf, stored=None):
    h, features = stored or (hourly(s, sf), _features(s, sf))
    return ft.next_hour_labels(features, h).where("data_quality_status = 'ok'")


def _split(s, sf):
    rows = _labelled(s, sf)
    return rk.chrono_split_at(rows, rk.split_instant(rows))


def _test(s, sf):
    """Test rows with label and the fixed scorer's prediction."""
    train, test = _split(s, sf)
    return rk.linear_score(rk.label(test, rk.target_threshold(train))).withColumn("predicted", (F.col("risk_score") >= 0.5).cast("int"))


def _flags(s, sf):
    h = hourly(s, sf)
    last = ft.latest_per_grid(_features(s, sf))
    model = last.select("grid_id", (F.col("avg_activity") > 500).cast("int").alias("model_flag"))
    last_day = h.agg((F.max("timestamp") - F.expr("INTERVAL 24 HOURS")).alias("since"))
    rules = sg.within_day_alerts(h).join(F.broadcast(last_day), F.col("timestamp") > F.col("since")).select("grid_id", F.lit(1).alias("rule_flag"))  # one row
    return cp.three_way(_anomalies(s, sf), model, rules)


def _fitted(s, sf, then, stored=None):
    """``then(model, training rows)``; the labelled rows are kept while the model is fitted."""
    kept = _labelled(s, sf, stored).select(*FEATURES, "label_timestamp", "next_hour_activity").persist()
    try:
        train = rk.chrono_split_at(kept, rk.split_instant(kept))[0]
        rows = rk.label(train, rk.target_threshold(train))
        return then(rk.fit_risk_model(rows), rows)
    finally:
        kept.unpersist()


def _model(s, sf, stored=None):
    return _fitted(s, sf, lambda model, _: model, stored)


def _scored_by_model(s, sf, how):
    """``how`` of the operators that score, on the features that its model was fitted to."""
    stored = _stored(s, sf)
    return how(stored[1], _model(s, sf, stored), "lr-1")


def _gradient(s, sf):
    """The gradient at the fitted weights; its size is that of rounding."""
    return _fitted(s, sf, lambda model, rows: rk.loss_gradient(rows, model)).select("feature", (F.abs("gradient") < 1e-6).alias("near_zero"))


def _scored(s, sf):
    return rk.linear_score(_features(s, sf).where("data_quality_status = 'ok'"))


def _risk_table(s, sf):
    return _scored(s, sf).select("grid_id", F.col("feature_timestamp").alias("timestamp"), "risk_score", "risk_level", "model_version")


def _check(s, sf):
    return ql.quality_check(hourly(s, sf), _features(s, sf), _risk_table(s, sf), _anomalies(s, sf))


def _status(s, sf):
    h = hourly(s, sf)
    return ql.status_record(_check(s, sf), "run-1", cl.clean_metrics(raw(s, sf)), wh.publication_summary(h, h), {"ingest": "success", "clean": "success", "score": "failed"})


def _health(s, sf):
    return ql.pipeline_health(_status(s, sf), hourly(s, sf)).select("run_id", "reasons", "freshness_hours", "healthy")


def _evidence(s, sf):
    risk = _risk_table(s, sf)
    last = risk.groupBy("grid_id").agg(F.max_by(F.struct("timestamp", "risk_score", "risk_level"), "timestamp").alias("r")).select("grid_id", "r.*")
    return ev.grid_evidence(_features(s, sf), _anomalies(s, sf), sg.all_alerts(hourly(s, sf)), last)


def _curated(s, sf):
    h = hourly(s, sf)
    return ev.incident_context(_evidence(s, sf), ev.recent_history(h), ev.historical_evidence(h, _anomalies(s, sf), _risk_table(s, sf)), _health(s, sf))


def _full(s, sf):
    return ev.incident_context_full(_evidence(s, sf), hourly(s, sf), _dim(s, sf), _health(s, sf))


def _validated(s, sf):
    odd = _features(s, sf).withColumn("internet_share", F.when(F.hour("feature_timestamp") == 7, F.col("internet_share") + 1).otherwise(F.col("internet_share")))
    return cl.validate_features(odd).select("grid_id", "feature_timestamp", "valid", "violations")


QUERIES = {
    "validate_features": lambda s, sf: plain(_validated(s, sf)),
    "chrono_split": lambda s, sf: plain(rk.split_report(*_split(s, sf))),
    "target_threshold": lambda s, sf: plain(rk.target_threshold(_split(s, sf)[0]).select(F.round("threshold", 9).alias("threshold"))),
    "label": lambda s, sf: plain(rk.label(_split(s, sf)[1], rk.target_threshold(_split(s, sf)[0])).groupBy("grid_id", "label").agg(F.count("*").alias("rows"))),
    "linear_score": lambda s, sf: plain(_scored(s, sf).select("grid_id", "feature_timestamp", F.round("risk_score", 9).alias("risk_score"), "risk_level")),
    "classification_metrics": lambda s, sf: plain(cp.classification_metrics(_test(s, sf))),
    "evaluate": lambda s, sf: plain(rk.evaluate(_test(s, sf))),
    "naive_baselines": lambda s, sf: plain(rk.naive_baselines(_test(s, sf), 500.0).withColumn("correlation", F.round("correlation", 9))),
    "agreement": lambda s, sf: plain(cp.agreement(cp.align_signals(_test(s, sf), bl.expanding_zscores(hourly(s, sf))), "predicted", "rule_flag")),
    "align_signals": lambda s, sf: plain(cp.align_signals(_labelled(s, sf), bl.expanding_zscores(hourly(s, sf))).select("grid_id", "label_timestamp", "rule_flag")),
    "three_way": lambda s, sf: plain(_flags(s, sf)),
    "signal_combinations": lambda s, sf: plain(cp.signal_combinations(_flags(s, sf))),
    "disagreement_samples": lambda s, sf: plain(cp.disagreement_samples(_flags(s, sf))),
    "quality_check": lambda s, sf: plain(_check(s, sf).drop("latest_feature")),
    "fit_risk_model": lambda s, sf: plain(rk.coefficients(s, _model(s, sf)).withColumn("coefficient", F.round("coefficient", 6))),
    "loss_gradient": lambda s, sf: plain(_gradient(s, sf)),
    "score_latest": lambda s, sf: plain(_scored_by_model(s, sf, rk.score_latest).select("grid_id", "timestamp", F.round("risk_score", 6).alias("risk_score"), "risk_level", "model_version")),
    "score": lambda s, sf: plain(_scored_by_model(s, sf, rk.score).select("grid_id", "feature_timestamp", "valid", F.round("risk_score", 6).alias("risk_score"), "risk_level")),
    "context_sizes": lambda s, sf: ev.context_sizes(_full(s, sf), _curated(s, sf)),
}

_G = "CAST(grid_id AS BIGINT) AS grid_id"
_F = "feature_timestamp"
_LAB = f"{_FEAT}, l AS (SELECT f.*, b.timestamp AS label_timestamp, CAST(b.total_activity AS DOUBLE) AS nxt FROM f JOIN h b ON f.grid_id = b.grid_id AND b.timestamp = f.{_F} + INTERVAL 1 HOUR WHERE data_quality_status = 'ok')"
_TRAIN = f"mi AS (SELECT to_timestamp((a + CAST(floor((b - a) * 0.6) AS BIGINT)) // 86400 * 86400) AT TIME ZONE 'UTC' AS middle FROM (SELECT CAST(epoch(min(label_timestamp)) AS BIGINT) AS a, CAST(epoch(max(label_timestamp)) AS BIGINT) AS b FROM l)), tr AS (SELECT l.* FROM l, mi WHERE label_timestamp < middle), te0 AS (SELECT l.* FROM l, mi WHERE label_timestamp >= middle), th AS (SELECT quantile_cont(nxt, 0.9) AS threshold FROM tr)"
_SCORE = "1 / (1 + exp(-(-1.0 + " + " + ".join(f"(coalesce(CAST({f} AS DOUBLE), {m}::DOUBLE) - {m}::DOUBLE) / {s}::DOUBLE * {w}::DOUBLE" for f, (m, s, w) in rk.LINEAR.items()) + ")))"
_TEST = f"te AS (SELECT *, CAST(nxt > threshold AS INTEGER) AS label, CAST({_SCORE} >= 0.5 AS INTEGER) AS predicted FROM te0, th)"
_CM = """c AS (SELECT count(*) FILTER (WHERE label = 1 AND {p}) AS tp, count(*) FILTER (WHERE label = 0 AND {p}) AS fp, count(*) FILTER (WHERE label = 1 AND NOT {p}) AS fn, count(*) FILTER (WHERE label = 0 AND NOT {p}) AS tn FROM te),
  cm AS (SELECT *, coalesce((tp + tn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0.0) AS accuracy, coalesce(tp::DOUBLE / nullif(tp + fp, 0), 0.0) AS precision, coalesce(tp::DOUBLE / nullif(tp + fn, 0), 0.0) AS recall, coalesce((tp + fn)::DOUBLE / nullif(tp + fp + fn + tn, 0), 0.0) AS base_rate FROM c)"""
_PRED = _CM.format(p="predicted = 1")
_ZS = """zx AS (SELECT grid_id, timestamp, total_activity AS x, count(*) OVER w AS n, sum(total_activity) OVER w AS s, sum(CAST(total_activity AS DECIMAL(18,2)) * total_activity) OVER w AS q FROM h WINDOW w AS (PARTITION BY grid_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
  zy AS (SELECT *, CAST(q * n - CAST(s AS DECIMAL(18,2)) * CAST(s AS DECIMAL(18,2)) AS DOUBLE) / nullif(CAST(n * n AS DOUBLE), 0) AS va FROM zx), zz AS (SELECT grid_id, timestamp, CASE WHEN va > 0 THEN (CAST(x AS DOUBLE) - CAST(s AS DOUBLE) / n) / sqrt(va) END AS z_score FROM zy)"""
_DAYS = """wd AS (SELECT grid_id, timestamp, CAST(total_activity AS DOUBLE) AS current, median(CAST(total_activity AS DOUBLE)) OVER (PARTITION BY grid_id, date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING EXCLUDE CURRENT ROW) AS baseline,
    lag(CAST(total_activity AS DOUBLE)) OVER (PARTITION BY grid_id ORDER BY timestamp) AS previous FROM h), tot AS (SELECT grid_id, CAST(sum(total_activity) AS DOUBLE) AS total FROM h GROUP BY grid_id),
  ru AS (SELECT DISTINCT grid_id FROM wd JOIN tot USING (grid_id) WHERE total >= (SELECT quantile_cont(total, 0.1) FROM tot) AND baseline > 0 AND timestamp > (SELECT max(timestamp) - INTERVAL 24 HOURS FROM h) AND (current > 1.5 * baseline OR (previous > 0 AND current > 1.5 * previous) OR current < 0.5 * baseline))"""
_FLAGS = f"{_ANOM}, {_FEAT}, {_DAYS}, la AS (SELECT grid_id, arg_max(avg_activity, {_F}) AS av FROM f GROUP BY grid_id), fl AS (SELECT a.grid_id, CAST(is_anomaly AS BIGINT) AS anomaly_flag, CAST(coalesce(av > 500, FALSE) AS BIGINT) AS model_flag, CAST(a.grid_id IN (SELECT grid_id FROM ru) AS BIGINT) AS rule_flag FROM a LEFT JOIN la USING (grid_id))"
_M7 = ", ".join("[" + ", ".join(f"sum(s * x[{i}] * x[{j}]){' + 1.0' if i == j > 1 else ''}" for j in range(1, 8)) + f", sum(r * x[{i}]){f' + w[{i}]' if i > 1 else ''}]" for i in range(1, 8))
_K = "CAST(k[1][1] AS INTEGER)"
#: Newton steps from sums of gradient and Hessian, each solved by elimination.
_NEWTON = f"""me AS (SELECT {", ".join(f"coalesce(quantile_cont(CAST({f} AS DOUBLE), 0.5), 0.0) AS {f}" for f in FEATURES)} FROM tr),
  fi AS (SELECT {", ".join(f"coalesce(CAST(tr.{f} AS DOUBLE), me.{f}) AS {f}" for f in FEATURES)}, CAST(nxt > threshold AS DOUBLE) AS y FROM tr, me, th),
  sc AS (SELECT {", ".join(f"avg({f}) AS m_{f}, coalesce(nullif(stddev_pop({f}), 0), 1.0) AS s_{f}" for f in FEATURES)} FROM fi),
  xs AS MATERIALIZED (SELECT [1.0::DOUBLE, {", ".join(f"({f} - m_{f}) / s_{f}" for f in FEATURES)}] AS x, y FROM fi, sc),
  nw(it, w) AS (SELECT 0, [0.0 FOR i IN range(7)]::DOUBLE[] UNION ALL SELECT it + 1, [w[i] - m[i][8] FOR i IN range(1, 8)] FROM (
    SELECT it, w, list_reduce([m0, {", ".join(f"[[{k}.0]]" for k in range(1, 8))}], lambda m, k: [CASE WHEN i = k[1][1] THEN [v / m[i][i] FOR v IN m[i]] ELSE [m[i][j] - m[i][{_K}] * m[{_K}][j] / m[{_K}][{_K}] FOR j IN range(1, 9)] END FOR i IN range(1, 8)]) AS m
    FROM (SELECT it, w, [{_M7}] AS m0 FROM (SELECT it, w, x, p - y AS r, p * (1 - p) AS s FROM (SELECT it, w, x, y, 1 / (1 + exp(-list_dot_product(w, x))) AS p FROM nw, xs WHERE it < 20)) GROUP BY it, w))),
  we AS (SELECT w FROM nw ORDER BY it DESC LIMIT 1),
  ri AS (SELECT f.*, 1 / (1 + exp(-list_dot_product(w, [1.0::DOUBLE, {", ".join(f"(coalesce(CAST(f.{x} AS DOUBLE), me.{x}) - m_{x}) / s_{x}" for x in FEATURES)}]))) AS s FROM f, me, sc, we)"""
_FIT = f"{WITH.replace('WITH', 'WITH RECURSIVE', 1)}, {_LAB}, {_TRAIN}, {_NEWTON}"
_LEVEL = "CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.3 THEN 'medium' WHEN s IS NOT NULL THEN 'low' END"
_BAD = ", ".join(
    [f"CASE WHEN {f} IS NULL THEN '{f} missing' END" for f in ("avg_activity", "activity_growth", "active_hours", "peak_ratio", "variability", "share")]
    + [f"CASE WHEN {f} < 0 THEN '{f} negative' END" for f in ("avg_activity", "active_hours", "peak_ratio", "variability", "share")]
    + ["CASE WHEN share > 1 THEN 'internet_share above 1' END"]
).replace("'share ", "'internet_share ")

ORACLES = {
    "validate_features": f"{WITH}, {_FEAT}, v AS (SELECT *, CASE WHEN hour({_F}) = 7 THEN internet_share + 1 ELSE internet_share END AS share FROM f), x AS (SELECT *, [b FOR b IN [{_BAD}] IF b IS NOT NULL] AS bad FROM v) SELECT {_G}, {t(_F)} AS {_F}, len(bad) = 0 AS valid, array_to_string(bad, ',') AS violations FROM x",
    "chrono_split": f"{WITH}, {_LAB}, {_TRAIN} SELECT (SELECT count(*) FROM tr) AS train_rows, (SELECT {t('max(label_timestamp)')} FROM tr) AS train_last, (SELECT count(*) FROM te0) AS test_rows, (SELECT {t('min(label_timestamp)')} FROM te0) AS test_first, TRUE AS in_order",
    "target_threshold": f"{WITH}, {_LAB}, {_TRAIN} SELECT round(threshold, 9) AS threshold FROM th",
    "label": f"{WITH}, {_LAB}, {_TRAIN}, {_TEST} SELECT {_G}, CAST(label AS BIGINT) AS label, count(*) AS rows FROM te GROUP BY te.grid_id, te.label",
    "linear_score": f"{WITH}, {_FEAT} SELECT {_G}, {t(_F)} AS {_F}, round(s, 9) AS risk_score, CASE WHEN s >= 0.7 THEN 'high' WHEN s >= 0.3 THEN 'medium' ELSE 'low' END AS risk_level FROM (SELECT *, {_SCORE} AS s FROM f WHERE data_quality_status = 'ok')",
    "classification_metrics": f"{WITH}, {_LAB}, {_TRAIN}, {_TEST}, {_PRED} SELECT * FROM cm",
    "evaluate": f"{WITH}, {_LAB}, {_TRAIN}, {_TEST}, {_PRED} SELECT *, tp + fn AS positives, tn + fp AS negatives, accuracy > 0.95 AS suspicious FROM cm",
    "naive_baselines": f"{WITH}, {_LAB}, {_TRAIN}, {_TEST}, {_CM.format(p='avg_activity > 500')} SELECT (SELECT avg(CAST(label = 0 AS DOUBLE)) FROM te) AS always_normal_accuracy, (SELECT round(corr(avg_activity, nxt), 9) FROM te) AS correlation, * FROM cm",
    "fit_risk_model": f"{_FIT}, c AS (SELECT unnest({FEATURES}) AS feature, unnest(w[2:]) AS v FROM we) SELECT row_number() OVER (ORDER BY abs(v) DESC) AS rank, feature, round(v, 6) AS coefficient FROM c",
    "loss_gradient": f"{_FIT}, g AS (SELECT unnest({['intercept', *FEATURES]}) AS feature, unnest([{', '.join(f'sum(r * x[{i}])' + (f' + any_value(w[{i}])' if i > 1 else '') for i in range(1, 8))}]) AS v FROM (SELECT x, w, 1 / (1 + exp(-list_dot_product(w, x))) - y AS r FROM xs, we)) SELECT feature, abs(v) < 1e-6 AS near_zero FROM g",
    "score_latest": f"{_FIT} SELECT {_G}, {t(_F)} AS timestamp, round(s, 6) AS risk_score, {_LEVEL} AS risk_level, 'lr-1' AS model_version FROM ri WHERE data_quality_status = 'ok' AND {_F} = (SELECT max({_F}) FROM f)",
    "score": f"{_FIT}, v AS (SELECT *, internet_share AS share FROM ri), x AS (SELECT *, len([b FOR b IN [{_BAD}] IF b IS NOT NULL]) = 0 AS valid FROM v) SELECT {_G}, {t(_F)} AS {_F}, valid, CASE WHEN valid THEN round(s, 6) END AS risk_score, CASE WHEN valid THEN {_LEVEL} END AS risk_level FROM x",
    "agreement": f"{WITH}, {_LAB}, {_TRAIN}, {_TEST}, {_ZS}, x AS (SELECT predicted = 1 AS a, coalesce(z_score >= 2, FALSE) AS b FROM te LEFT JOIN zz ON te.grid_id = zz.grid_id AND te.label_timestamp = zz.timestamp) SELECT count(*) FILTER (WHERE a AND b) AS both, count(*) FILTER (WHERE a AND NOT b) AS first_only, count(*) FILTER (WHERE b AND NOT a) AS second_only, count(*) FILTER (WHERE NOT a AND NOT b) AS neither, count(*) FILTER (WHERE a = b)::DOUBLE / count(*) AS agreement_rate FROM x",
    "align_signals": f"{WITH}, {_LAB}, {_ZS} SELECT CAST(l.grid_id AS BIGINT) AS grid_id, {t('label_timestamp')} AS label_timestamp, CAST(coalesce(z_score >= 2, FALSE) AS BIGINT) AS rule_flag FROM l LEFT JOIN zz ON l.grid_id = zz.grid_id AND l.label_timestamp = zz.timestamp",
    "three_way": f"{WITH}, {_FLAGS} SELECT {_G}, anomaly_flag, model_flag, rule_flag FROM fl",
    "signal_combinations": f"{WITH}, {_FLAGS} SELECT model_flag, rule_flag, anomaly_flag, count(*) AS grids FROM fl GROUP BY ALL",
    "disagreement_samples": f'{WITH}, {_FLAGS}, x AS (SELECT {_G}, anomaly_flag, model_flag, rule_flag, concat_ws(\'+\', CASE WHEN model_flag = 1 THEN \'model\' END, CASE WHEN rule_flag = 1 THEN \'rule\' END, CASE WHEN anomaly_flag = 1 THEN \'anomaly\' END) AS "case" FROM fl) SELECT * FROM x WHERE "case" <> \'\' QUALIFY row_number() OVER (PARTITION BY "case" ORDER BY grid_id) <= 5',
    "quality_check": f"{WITH}, {_FEAT}, {_ANOM}, o AS (SELECT * FROM f WHERE data_quality_status = 'ok') SELECT count(*) AS fact_rows, CAST(0 AS BIGINT) AS duplicate_grain_groups, count(*) AS feature_rows, (SELECT count(*) FROM o WHERE {_F} = (SELECT max({_F}) FROM f)) AS risk_rows, CAST(0 AS BIGINT) AS duplicate_risk_groups, CAST(0 AS BIGINT) AS blank_versions, (SELECT count(*) FROM a) AS anomaly_rows, CASE WHEN (SELECT count(*) FROM o WHERE {_F} = (SELECT max({_F}) FROM f)) = 0 THEN 'risk covers the latest features' ELSE '' END AS failed_rules, (SELECT count(*) FROM o WHERE {_F} = (SELECT max({_F}) FROM f)) > 0 AS passed FROM h",
}
