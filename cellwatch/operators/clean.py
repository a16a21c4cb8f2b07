"""Cleaning: canonical names, rejected rows, filled measures, derived columns and contracts."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, functions as F

from cellwatch.functions.expressions import FEATURES, GRID_MAX, GRID_MIN, MEASURES, RAW_NAMES, TIME_FORMAT, kind


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` if it has all the columns, else an error that names the missing ones."""
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def canonicalize(raw: DataFrame) -> DataFrame:
    """Canonical names; a time that can't be read becomes null."""
    out = require_columns(raw, list(RAW_NAMES)).withColumnsRenamed(RAW_NAMES)
    if kind(out, "timestamp").typeName() == "string":
        out = out.withColumn("timestamp", F.try_to_timestamp("timestamp", F.lit(TIME_FORMAT)))
    return out


def _lacks_ids() -> Column:
    return F.col("grid_id").isNull() | F.col("timestamp").isNull()


def _is_negative() -> Column:
    """A null measure is not negative."""
    return reduce(or_, (F.coalesce(F.col(m) < 0, F.lit(False)) for m in MEASURES))


def reject_missing_ids(df: DataFrame) -> DataFrame:
    return df.where(~_lacks_ids())


def reject_negative(df: DataFrame) -> DataFrame:
    return df.where(~_is_negative())


def fill_measures(df: DataFrame) -> DataFrame:
    """Blank activity is no activity."""
    return df.withColumns({m: F.coalesce(m, F.lit(0).cast(kind(df, m))) for m in MEASURES})


def clean(raw: DataFrame) -> DataFrame:
    """Canonical rows without those that lack ids or have a negative measure, blanks filled, with their date."""
    out = fill_measures(reject_negative(reject_missing_ids(canonicalize(raw))))
    return out.withColumn("date", F.date_format("timestamp", "yyyy-MM-dd"))


def clean_metrics(raw: DataFrame) -> DataFrame:
    """One row that accounts for every input row, from one pass."""
    df = canonicalize(raw)
    no_ids, negative = _lacks_ids(), ~_lacks_ids() & _is_negative()
    kept = ~_lacks_ids() & ~_is_negative()
    blanks = reduce(lambda a, b: a + b, (F.col(m).isNull().cast("int") for m in MEASURES))
    out = df.agg(
        F.count("*").alias("input_rows"),
        F.count_if(no_ids).alias("rejected_ids"),
        F.count_if(negative).alias("rejected_negative"),
        F.coalesce(F.sum(F.when(kept, blanks)), F.lit(0)).cast("bigint").alias("nulls_handled"),
        F.count_if(kept).alias("output_rows"),
    )
    return out.withColumn("balanced", F.col("input_rows") == F.col("rejected_ids") + F.col("rejected_negative") + F.col("output_rows"))


def with_time_parts(df: DataFrame) -> DataFrame:
    return df.withColumns({"date": F.date_format("timestamp", "yyyy-MM-dd"), "hour": F.hour("timestamp"), "day_of_week": F.date_format("timestamp", "EEEE")})


def with_totals(df: DataFrame) -> DataFrame:
    sms, calls = F.col("sms_in") + F.col("sms_out"), F.col("call_in") + F.col("call_out")
    return df.withColumns({"total_sms": sms, "total_calls": calls, "total_activity": sms + calls + F.col("internet_activity")})


def with_internet_share(df: DataFrame) -> DataFrame:
    """Share of internet in a row's total; 0 where there is no activity."""
    share = F.col("internet_activity").cast("double") / F.nullif(F.col("total_activity").cast("double"), F.lit(0.0))
    return df.withColumn("internet_share", F.when(F.col("total_activity") > 0, share).otherwise(0.0))


def reconcile(a: DataFrame, b: DataFrame, measures: list[str], tolerance: float = 0.01) -> DataFrame:
    """One row: whether two tables have as many rows and the same sums, within the tolerance."""
    sums = lambda df, tag: df.agg(F.count("*").alias(f"rows_{tag}"), *(F.coalesce(F.sum(m).cast("double"), F.lit(0.0)).alias(f"{m}_{tag}") for m in measures))
    both = sums(a, "a").crossJoin(sums(b, "b"))  # one row each
    worst = F.greatest(F.lit(0.0), *(F.abs(F.col(f"{m}_a") - F.col(f"{m}_b")) for m in measures))
    out = both.select("rows_a", "rows_b", worst.alias("largest_difference"))
    return out.withColumn("matches", (F.col("rows_a") == F.col("rows_b")) & (F.col("largest_difference") <= tolerance))


def validate_features(df: DataFrame) -> DataFrame:
    """``valid`` and the ``violations`` of each feature row: missing values, negatives, a share outside 0 to 1."""
    told = [F.when(F.col(f).isNull(), f"{f} missing") for f in FEATURES]
    told += [F.when(F.col(f) < 0, f"{f} negative") for f in ("avg_activity", "active_hours", "peak_ratio", "variability", "internet_share")]
    told.append(F.when(F.col("internet_share") > 1, "internet_share above 1"))
    out = df.withColumn("violations", F.array_compact(F.array(*told)))
    return out.withColumn("valid", F.size("violations") == 0)


def require_grid(dim_grid: DataFrame, grid_id: int) -> DataFrame:
    """The cell's row of the dimension; an id out of range or unknown is an error, not an empty answer."""
    if not GRID_MIN <= grid_id <= GRID_MAX:
        raise ValueError(f"grid_id {grid_id} is not within {GRID_MIN}..{GRID_MAX}")
    found = dim_grid.where(F.col("grid_id") == grid_id)
    if found.isEmpty():
        raise LookupError(f"grid_id {grid_id} is unknown")
    return found


def known_grids(requests: DataFrame, dim_grid: DataFrame) -> DataFrame:
    """Those requested ids that are in range and in the dimension."""
    return requests.where(F.col("grid_id").between(GRID_MIN, GRID_MAX)).join(dim_grid.select("grid_id"), "grid_id", "left_semi")
