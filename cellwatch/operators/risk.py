"""Next-hour risk: split, target, model, evaluation and batch scoring."""

from __future__ import annotations

import dataclasses
import json
import math

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellwatch.functions.expressions import FEATURES, risk_level
from cellwatch.operators.clean import require_columns, validate_features
from cellwatch.operators.compare import classification_metrics
from cellwatch.operators.percentiles import exact_percentiles

TARGET_PERCENTILE = 0.9
SUSPICIOUS_ACCURACY = 0.95
#: Newton steps at most, and the size of a step that is the last: the error after it is of the order of its square.
NEWTON_STEPS, NEWTON_END = 50, 1e-7


@dataclasses.dataclass(frozen=True)
class RiskModel:
    """Imputation, scaling and weights, in the order of FEATURES."""

    medians: tuple[float, ...]
    means: tuple[float, ...]
    stds: tuple[float, ...]
    weights: tuple[float, ...]
    intercept: float

    def scaled(self) -> list[Column]:
        """The features, filled and standardised."""
        return [(F.coalesce(F.col(f).cast("double"), F.lit(a)) - m) / s for f, a, m, s in zip(FEATURES, self.medians, self.means, self.stds)]

    def probability(self) -> Column:
        z = F.lit(self.intercept)
        for x, w in zip(self.scaled(), self.weights):
            z = z + x * w
        return 1 / (1 + F.exp(-z))


def chrono_split(df: DataFrame, start, middle, end, column: str = "label_timestamp") -> tuple[DataFrame, DataFrame]:
    """Rows of [start, middle) to train on and of [middle, end) to test on."""
    at = lambda x: F.lit(x).cast("timestamp")
    c = F.col(column)
    return df.where((c >= at(start)) & (c < at(middle))), df.where((c >= at(middle)) & (c < at(end)))


def split_instant(df: DataFrame, share: float = 0.6, column: str = "label_timestamp") -> DataFrame:
    """One row ``middle``: the midnight before the instant that has this share of the data's time behind it."""
    ends = df.agg(F.min(F.unix_timestamp(column)).alias("a"), F.max(F.unix_timestamp(column)).alias("b"))
    return ends.select(F.timestamp_seconds(F.floor((F.col("a") + F.floor((F.col("b") - F.col("a")) * share)) / 86400) * 86400).alias("middle"))


def chrono_split_at(df: DataFrame, middle: DataFrame, column: str = "label_timestamp") -> tuple[DataFrame, DataFrame]:
    """All rows, those before the one-row frame's ``middle`` to train on and the others to test on."""
    rows = df.crossJoin(F.broadcast(middle))  # one row
    return rows.where(F.col(column) < F.col("middle")).drop("middle"), rows.where(F.col(column) >= F.col("middle")).drop("middle")


def split_report(train: DataFrame, test: DataFrame, column: str = "label_timestamp") -> DataFrame:
    """One row: sizes, and whether all of training lies before all of testing."""
    a = train.agg(F.count("*").alias("train_rows"), F.max(column).alias("train_last"))
    b = test.agg(F.count("*").alias("test_rows"), F.min(column).alias("test_first"))
    return a.crossJoin(b).withColumn("in_order", F.coalesce(F.col("train_last") < F.col("test_first"), F.lit(True)))  # one row each


def target_threshold(train: DataFrame, share: float = TARGET_PERCENTILE) -> DataFrame:
    """One row: percentile of the training rows' next-hour activity, linearly interpolated."""
    return exact_percentiles(train, ["next_hour_activity"], share).withColumnRenamed("next_hour_activity", "threshold")


def label(df: DataFrame, threshold: DataFrame | float) -> DataFrame:
    """1 where the next hour exceeds the threshold."""
    x = F.col("next_hour_activity").cast("double")
    if isinstance(threshold, DataFrame):
        return df.crossJoin(F.broadcast(threshold)).withColumn("label", (x > F.col("threshold")).cast("int"))  # one row
    return df.withColumn("label", (x > threshold).cast("int"))


def _scaling(train: DataFrame) -> list[dict[str, float]]:
    """Median, mean and population deviation of each feature after imputation; a constant one is divided by 1."""
    medians = exact_percentiles(train, FEATURES, 0.5).first()
    filled = train.select(*(F.coalesce(F.col(f).cast("double"), F.lit(medians[f] or 0.0)).alias(f) for f in FEATURES))
    told = filled.agg(*(F.avg(f).alias(f"m_{f}") for f in FEATURES), *(F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES)).first()
    return [{"feature": f, "median": medians[f] or 0.0, "mean": told[f"m_{f}"] or 0.0, "std": told[f"s_{f}"] or 1.0} for f in FEATURES]


def fit_risk_model(train: DataFrame, c: float = 1.0) -> RiskModel:
    """Median imputation, standardisation and L2 logistic regression on ``train(features, label)``; the penalty is
    that of an inverse strength ``c`` on the summed loss, and leaves the intercept free. No rows, or rows of one label only, are an error.

    Newton's method: each step is one pass that sums gradient and Hessian (35 numbers), so the optimum is the same however rows are
    partitioned, and ``loss_gradient`` shows it.
    """
    scale = _scaling(train)
    start = RiskModel(*(tuple(s[k] for s in scale) for k in ("median", "mean", "std")), weights=(0.0,) * len(FEATURES), intercept=0.0)
    rows = train.select(F.lit(1.0).alias("x0"), *(x.alias(f"x{i + 1}") for i, x in enumerate(start.scaled())), F.col("label").cast("double").alias("y")).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        n, positives = rows.agg(F.count("*"), F.sum("y")).first()
        if not n:
            raise ValueError("no training rows")
        if positives in (0, n):
            raise ValueError("training rows of one label only")
        weights = np.zeros(len(FEATURES) + 1)
        penalty = np.array([0.0] + [1.0 / c] * len(FEATURES))
        loss = math.inf
        step = np.zeros_like(weights)
        for _ in range(NEWTON_STEPS):
            now, gradient, hessian = _loss_sums(rows, weights, penalty)
            if now > loss * (1 + 1e-12) + 1e-12:  # too far: half the way back
                step = step / 2
                weights = weights - step
                continue
            loss = now
            step = -np.linalg.solve(hessian, gradient)
            weights = weights + step
            if np.abs(step).max() < NEWTON_END:
                break
        return dataclasses.replace(start, weights=tuple(map(float, weights[1:])), intercept=float(weights[0]))
    finally:
        rows.unpersist()


def _loss_sums(rows: DataFrame, weights: np.ndarray, penalty: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The penalised loss of rows ``(x0.., y)``, its gradient and its Hessian, from one pass."""
    k = len(weights)
    # the weights are a row and not literals, so every step runs the same compiled code
    told = rows.sparkSession.createDataFrame([tuple(map(float, weights))], ", ".join(f"w{i} double" for i in range(k)))
    z = sum((F.col(f"x{i}") * F.col(f"w{i}") for i in range(1, k)), F.col("x0") * F.col("w0"))
    at = rows.crossJoin(F.broadcast(told)).withColumn("z", z).withColumn("p", 1 / (1 + F.exp(-F.col("z"))))
    loss = F.sum(F.greatest("z", F.lit(0.0)) - F.col("z") * F.col("y") + F.log1p(F.exp(-F.abs("z"))))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    x = lambda i: F.col(f"x{i}")
    told = at.agg(loss, *(F.sum((F.col("p") - F.col("y")) * x(i)) for i in range(k)), *(F.sum(F.col("p") * (1 - F.col("p")) * x(i) * x(j)) for i, j in pairs)).first()
    gradient = np.array(told[1 : k + 1]) + penalty * weights
    hessian = np.diag(penalty)
    for (i, j), v in zip(pairs, told[k + 1 :]):
        hessian[i, j] += v
        hessian[j, i] = hessian[i, j]
    return told[0] + float(penalty @ weights**2) / 2, gradient, hessian


def loss_gradient(train: DataFrame, model: RiskModel, c: float = 1.0) -> DataFrame:
    """``(feature, gradient)`` of the penalised loss at a model's weights; near 0 at the optimum."""
    rows = train.select(*(x.alias(f) for f, x in zip(FEATURES, model.scaled())), (model.probability() - F.col("label")).alias("r"))
    sums = rows.agg(F.sum("r").alias("intercept"), *((F.sum(F.col("r") * F.col(f)) + w / c).alias(f) for f, w in zip(FEATURES, model.weights)))
    return sums.select(F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("gradient")) for f in ("intercept", *FEATURES)))).alias("g")).select("g.*")


def _probability(df: DataFrame, model: RiskModel) -> DataFrame:
    return df.withColumn("risk_score", model.probability())


def predict(df: DataFrame, model: RiskModel) -> DataFrame:
    return _probability(df, model).withColumn("predicted", (F.col("risk_score") >= 0.5).cast("int"))


def evaluate(predicted: DataFrame) -> DataFrame:
    """One row: metrics, class balance, and a warning where the accuracy is too good to be trusted."""
    out = classification_metrics(predicted)
    balance = out.withColumns({"positives": F.col("tp") + F.col("fn"), "negatives": F.col("tn") + F.col("fp")})
    return balance.withColumn("suspicious", F.col("accuracy") > SUSPICIOUS_ACCURACY)


def coefficients(spark: SparkSession, model: RiskModel) -> DataFrame:
    """Features by the size of their weight."""
    rows = sorted(zip(FEATURES, model.weights), key=lambda x: -abs(x[1]))
    return spark.createDataFrame([(i + 1, f, w) for i, (f, w) in enumerate(rows)], "rank int, feature string, coefficient double")


def save_model(model: RiskModel, path: str, version: str, threshold: float) -> None:
    """The model, and with it what scoring must know of it, as one JSON text."""
    told = {"version": version, "features": FEATURES, "threshold": threshold, "model": dataclasses.asdict(model)}
    spark = SparkSession.getActiveSession()
    spark.createDataFrame([(json.dumps(told),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def load_model(spark: SparkSession, path: str) -> tuple[RiskModel, dict]:
    """Refuses a model without a version or with other features."""
    told = json.loads("".join(r[0] for r in spark.read.text(path).collect()))
    if not told.get("version") or "features" not in told or "model" not in told:
        raise ValueError("the model's metadata is incomplete")
    if told["features"] != FEATURES:
        raise ValueError(f"the model has other features: {told['features']}")
    own = {k: tuple(v) if isinstance(v, list) else v for k, v in told.pop("model").items()}
    return RiskModel(**own), told


def _told(df: DataFrame, version: str) -> DataFrame:
    level = risk_level(F.col("risk_score"))
    note = F.format_string("Model %s puts the chance of high activity in the next hour at %.2f", F.lit(version), "risk_score")
    return df.withColumns({"risk_level": level, "model_version": F.lit(version), "reason": note})


def score(df: DataFrame, model: RiskModel, version: str) -> DataFrame:
    """Scores of given feature vectors; those that break the feature contract get none."""
    checked = validate_features(require_columns(df, FEATURES))
    scored = _told(_probability(checked, model), version)
    keep = ["risk_score", "risk_level", "reason"]
    return scored.withColumns({c: F.when(F.col("valid"), F.col(c)) for c in keep})


def latest_scorable(features: DataFrame) -> DataFrame:
    """The ``ok`` rows of the latest snapshot."""
    last = features.agg(F.max("feature_timestamp").alias("last"))
    rows = features.join(F.broadcast(last), F.col("feature_timestamp") == F.col("last")).drop("last")  # one row
    return rows.where(F.col("data_quality_status") == "ok")


def score_latest(features: DataFrame, model: RiskModel, version: str) -> DataFrame:
    """Risk rows of the latest snapshot. No features, or none fit to score, are errors."""
    if features.isEmpty():
        raise LookupError("no feature rows")
    rows = latest_scorable(features)
    if rows.isEmpty():
        raise LookupError("no feature rows of status ok in the latest snapshot")
    out = _told(_probability(rows, model), version)
    return out.select("grid_id", F.col("feature_timestamp").alias("timestamp"), "risk_score", "risk_level", "model_version", "reason")


#: Weights of the fixed scorer: per feature a centre, a width and a weight.
LINEAR = {"avg_activity": (500.0, 250.0, 1.2), "activity_growth": (0.0, 0.5, 0.4), "active_hours": (24.0, 4.0, 0.1), "peak_ratio": (2.0, 1.0, 0.3), "variability": (0.5, 0.3, -0.2), "internet_share": (0.3, 0.2, 0.5)}
LINEAR_INTERCEPT = -1.0


def linear_score(features: DataFrame, version: str = "linear-1") -> DataFrame:
    """Risk of feature rows by fixed weights; a missing feature sits at its centre."""
    terms = [(F.coalesce(F.col(f).cast("double"), F.lit(m)) - m) / s * w for f, (m, s, w) in LINEAR.items()]
    z = F.lit(LINEAR_INTERCEPT)
    for t in terms:
        z = z + t
    out = features.withColumn("risk_score", 1 / (1 + F.exp(-z)))
    return out.withColumns({"risk_level": risk_level(F.col("risk_score")), "model_version": F.lit(version)})


def naive_baselines(test: DataFrame, threshold: float) -> DataFrame:
    """One row: accuracy of always saying normal, correlation of mean activity with the next hour, and metrics of a rule on mean activity."""
    told = test.agg(F.avg((F.col("label") == 0).cast("double")).alias("always_normal_accuracy"), F.corr(F.col("avg_activity").cast("double"), F.col("next_hour_activity").cast("double")).alias("correlation"))
    rule = classification_metrics(test.withColumn("predicted", (F.col("avg_activity") > threshold).cast("int")))
    return told.crossJoin(rule)  # one row each
