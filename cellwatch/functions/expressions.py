"""Column expressions and fixed values that the operators share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

#: Raw names and their canonical ones, in file order.
RAW_NAMES = {
    "datetime": "timestamp",
    "CellID": "grid_id",
    "countrycode": "country_code",
    "smsin": "sms_in",
    "smsout": "sms_out",
    "callin": "call_in",
    "callout": "call_out",
    "internet": "internet_activity",
}
MEASURES = ["sms_in", "sms_out", "call_in", "call_out", "internet_activity"]
TOTALS = ["total_sms", "total_calls", "total_activity"]
TIME_FORMAT = "yyyy-MM-dd HH:mm:ss"
GRID_MIN, GRID_MAX = 1, 10000
#: Fixed values of the rules.
HIGH_RATIO, SPIKE_RATIO, DROP_RATIO, FLOOR_PERCENTILE = 1.5, 1.5, 0.5, 0.1
SEVERITY_HIGH, SEVERITY_MEDIUM = 3.0, 2.0
ANOMALY_Z, ANOMALY_MIN_SAMPLES = 2.0, 2
RISK_HIGH, RISK_MEDIUM = 0.70, 0.30
WINDOW_HOURS = 24
FEATURES = ["avg_activity", "activity_growth", "active_hours", "peak_ratio", "variability", "internet_share"]


def kind(df: DataFrame, name: str) -> T.DataType:
    return df.schema[name].dataType


def ratio(x: Column, y: Column) -> Column:
    """x / y in double precision, null where y is 0 or null."""
    return x.cast("double") / F.nullif(y.cast("double"), F.lit(0.0))


def mean(c: Column | str) -> Column:
    """Mean of an aggregate or window group; exact sums for decimals."""
    return F.sum(c).cast("double") / F.nullif(F.count(c), F.lit(0))


def square(df: DataFrame, name: str) -> Column:
    """Square of a measure; a decimal one is narrowed so that its sums stay exact."""
    c = F.col(name).cast("decimal(18,2)") if isinstance(kind(df, name), T.DecimalType) and kind(df, name).scale <= 2 else F.col(name)
    return c * c


def pop_variance(n: Column, total: Column, squares: Column) -> Column:
    """Population variance from count, sum and sum of squares, never below 0; exact before the one division for decimals."""
    n = n.cast("bigint")
    spread = (squares * n.cast("decimal(12,0)") - total * total).cast("double")
    return F.greatest(spread / F.nullif((n * n).cast("double"), F.lit(0.0)), F.lit(0.0))


def risk_level(score: Column) -> Column:
    """high from 0.70, medium from 0.30, else low; null stays null."""
    return F.when(score >= RISK_HIGH, "high").when(score >= RISK_MEDIUM, "medium").when(score.isNotNull(), "low")
