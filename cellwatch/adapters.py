"""The driver's event stream seen as activity: hour, cell and country of an event, its value in the channel of its type."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

#: Channel of each event type.
CHANNELS = {"signup": "smsin", "error": "smsout", "click": "callin", "view": "callout", "purchase": "internet"}
#: Users of one cell, so that cells grow with the events and each has events in most hours.
USERS_PER_CELL = 40


def raw_activity_from_events(spark: SparkSession, sf_dir: str, faults: bool = False) -> DataFrame:
    """Raw-grain rows; with ``faults`` some cells are missing, some times are unreadable and some values negative."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", "user_id", "event_type", "value", "props")
    time = F.date_format(F.date_trunc("hour", F.col("ts").cast("timestamp")), "yyyy-MM-dd HH:mm:ss")
    cell = (F.floor(F.col("user_id") / USERS_PER_CELL) + 1).cast("int")
    value = F.col("value").cast("decimal(18,2)")
    if faults:
        time = F.when(F.col("event_id") % 83 == 0, "NOT-A-DATE").otherwise(time)
        cell = F.when(F.col("event_id") % 89 == 0, F.lit(None).cast("int")).otherwise(cell)
        value = F.when(F.col("event_id") % 97 == 0, (-value).cast("decimal(18,2)")).otherwise(value)
    return e.select(
        time.alias("datetime"),
        cell.alias("CellID"),
        F.get_json_object("props", "$.k").cast("int").alias("countrycode"),
        *(F.when(F.col("event_type") == kind, value).alias(name) for kind, name in CHANNELS.items()),
    )


def cell_count(spark: SparkSession, sf_dir: str) -> int:
    """The largest cell id of the events."""
    most = spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("user_id")).first()[0]
    return 0 if most is None else most // USERS_PER_CELL + 1


def square_cells(spark: SparkSession, n: int, per_row: int = 100, side: float = 0.003, lon: float = 9.0, lat: float = 45.35) -> DataFrame:
    """``(grid_id, ring, geometry_json)``: unit squares in rows, for tables that have no geometry of their own."""
    at = F.col("id")
    x, y = F.lit(lon) + (at % per_row) * side, F.lit(lat) + F.floor(at / per_row) * side
    corner = lambda dx, dy: F.array(x + dx * side, y + dy * side)
    ring = F.array(corner(0, 0), corner(1, 0), corner(1, 1), corner(0, 1), corner(0, 0))
    out = spark.range(n).select((at + 1).cast("int").alias("grid_id"), ring.alias("ring"))
    return out.withColumn("geometry_json", F.to_json(F.struct(F.lit("Polygon").alias("type"), F.array("ring").alias("coordinates"))))
