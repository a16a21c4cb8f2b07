"""What the queries and their SQL share: the tables made from the driver's events on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cellwatch.adapters import raw_activity_from_events
from cellwatch.operators.aggregate import hourly_grid_summary
from cellwatch.operators.clean import clean

#: An instant inside the data, for queries that take one.
AS_OF = "2024-01-20 12:00:00"


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    return raw_activity_from_events(spark, sf_dir, faults=True)


def cleaned(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(raw(spark, sf_dir))


def hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly_grid_summary(cleaned(spark, sf_dir))


def plain(df: DataFrame) -> DataFrame:
    """Result columns in types that every engine writes alike: decimals as doubles, times as text, counts as longs."""
    out = []
    for f in df.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, T.DecimalType):
            c = c.cast("double")
        elif isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            c = F.date_format(c, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(f.dataType, T.DateType):
            c = F.date_format(c, "yyyy-MM-dd")
        elif isinstance(f.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        elif isinstance(f.dataType, T.ArrayType):
            c = F.concat_ws(",", c.cast("array<string>"))
        out.append(c.alias(f.name))
    return df.select(*out)


_M = ("sms_in", "sms_out", "call_in", "call_out", "internet_activity")
_EACH = lambda form: ", ".join(form.format(m=m) for m in _M)
#: The same tables in SQL, as a chain of common table expressions.
WITH = f"""
WITH e0 AS (
  SELECT event_id, user_id, event_type, props, date_trunc('hour', ts) AS hour_ts,
         CAST(value AS DECIMAL(18,2)) * (CASE WHEN event_id % 97 = 0 THEN -1 ELSE 1 END) AS v FROM events),
e1 AS (
  SELECT CASE WHEN event_id % 83 = 0 THEN NULL ELSE hour_ts END AS timestamp,
         CASE WHEN event_id % 89 = 0 THEN NULL ELSE CAST(user_id // 40 + 1 AS INTEGER) END AS grid_id,
         CAST(json_extract_string(props, '$.k') AS INTEGER) AS country_code, event_type, CAST(v AS DECIMAL(18,2)) AS v FROM e0),
canon AS (
  SELECT timestamp, grid_id, country_code, CASE WHEN event_type = 'signup' THEN v END AS sms_in, CASE WHEN event_type = 'error' THEN v END AS sms_out,
         CASE WHEN event_type = 'click' THEN v END AS call_in, CASE WHEN event_type = 'view' THEN v END AS call_out, CASE WHEN event_type = 'purchase' THEN v END AS internet_activity FROM e1),
flagged AS (SELECT *, (timestamp IS NULL OR grid_id IS NULL) AS no_ids, ({" OR ".join(f"coalesce({m} < 0, FALSE)" for m in _M)}) AS negative FROM canon),
clean AS (SELECT timestamp, grid_id, country_code, {_EACH("coalesce({m}, 0) AS {m}")}, strftime(timestamp, '%Y-%m-%d') AS date FROM flagged WHERE NOT no_ids AND NOT negative),
h0 AS (SELECT grid_id, timestamp, {_EACH("CAST(sum({m}) AS DECIMAL(18,2)) AS {m}")} FROM clean GROUP BY grid_id, timestamp),
h AS (SELECT *, sms_in + sms_out AS total_sms, call_in + call_out AS total_calls, CAST(sms_in + sms_out + call_in + call_out + internet_activity AS DECIMAL(18,2)) AS total_activity,
        strftime(timestamp, '%Y-%m-%d') AS date, hour(timestamp) AS hour FROM h0)
"""


#: The largest cell id, in SQL.
CELLS = "(SELECT CAST(max(user_id) // 40 + 1 AS BIGINT) FROM events)"


def t(c: str) -> str:
    """A time as text, in SQL."""
    return f"strftime({c}, '%Y-%m-%d %H:%M:%S')"


def d(*names: str) -> str:
    """Columns as doubles, in SQL."""
    return ", ".join(f"CAST({n} AS DOUBLE) AS {n}" for n in names)


#: Mean and population deviation of a decimal group, in SQL.
MEAN = "CAST(sum({x}) AS DOUBLE) / nullif(count({x}), 0)"
VAR = "greatest(CAST(sum(CAST({x} AS DECIMAL(18,2)) * CAST({x} AS DECIMAL(18,2))) * count({x}) - CAST(sum({x}) AS DECIMAL(18,2)) * CAST(sum({x}) AS DECIMAL(18,2)) AS DOUBLE) / CAST(count({x}) * count({x}) AS DOUBLE), 0.0)"
