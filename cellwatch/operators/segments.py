"""Windows over long histories: a key's time is cut into chunks, so that no task holds the whole history of one key.

Expanding sums are a segmented prefix scan: running sums within each chunk, on top of the scanned totals of the chunks before. Trailing
frames see a halo: the end of the chunks before, as far back as the frame reaches, is copied to a chunk and dropped after the window.
Only chunk totals of one key meet in one task, one row for each chunk that has data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

#: Hours of a chunk. Two weeks bound a window's rows by 336 an hourly key, and a halo of 47 hours copies a seventh of the rows.
CHUNK_HOURS = 336


def with_chunk(rows: DataFrame, time: str = "timestamp", hours: int = CHUNK_HOURS) -> DataFrame:
    """``rows`` with ``chunk``, the number of its stretch of time."""
    return rows.withColumn("chunk", F.floor(F.unix_timestamp(time) / (hours * 3600)))


def with_halo(rows: DataFrame, reach_hours: int, time: str = "timestamp", hours: int = CHUNK_HOURS) -> DataFrame:
    """``rows`` with ``epoch``, ``chunk`` and ``halo``: each row in its chunk, and as halo in all later chunks whose frames reach back to it."""
    size = hours * 3600
    rows = rows.withColumn("epoch", F.unix_timestamp(time))
    own = F.floor(F.col("epoch") / size)
    last = F.floor((F.col("epoch") + reach_hours * 3600) / size)
    return rows.withColumn("own", own).withColumn("chunk", F.explode(F.sequence("own", last))).withColumn("halo", F.col("chunk") > F.col("own")).drop("own")


def by_chunk(key: str = "grid_id", order: str = "epoch") -> WindowSpec:
    return Window.partitionBy(key, "chunk").orderBy(order)


def expanding_sums(rows: DataFrame, sums: dict[str, Column], key: str = "grid_id", time: str = "timestamp", hours: int = CHUNK_HOURS) -> DataFrame:
    """``rows`` with the sums of ``sums`` (name: expression without nulls) over all earlier rows of the key; 0 for a first row.

    A key has at most one row at a time. Exact for decimals and whole numbers; doubles add up chunk by chunk.
    """
    rows = with_chunk(rows, time, hours).withColumns({f"_{name}": x for name, x in sums.items()})
    totals = rows.groupBy(key, "chunk").agg(*(F.sum(f"_{name}").alias(name) for name in sums))
    kinds = {name: totals.schema[name].dataType for name in sums}
    zero = lambda c, name: F.coalesce(c, F.lit(0).cast(kinds[name]))
    chunks = Window.partitionBy(key).orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = totals.select(key, "chunk", *(zero(F.sum(name).over(chunks).cast(kinds[name]), name).alias(f"_{name}_before") for name in sums))
    inner = by_chunk(key, time).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumns({f"_{name}_within": zero(F.sum(f"_{name}").over(inner), name) for name in sums}).join(before, [key, "chunk"])
    rows = rows.withColumns({name: (F.col(f"_{name}_within") + F.col(f"_{name}_before")).cast(kinds[name]) for name in sums})
    return rows.drop("chunk", *(f"_{name}{x}" for name in sums for x in ("", "_within", "_before")))


def previous_value(rows: DataFrame, column: str, key: str = "grid_id", time: str = "timestamp", hours: int = CHUNK_HOURS) -> DataFrame:
    """``rows`` with ``previous``: the key's value at its last earlier row, however long ago; null for a first row."""
    rows = with_chunk(rows, time, hours)
    ends = rows.groupBy(key, "chunk").agg(F.max_by(column, time).alias("end"))
    ends = ends.select(key, "chunk", F.lag("end").over(Window.partitionBy(key).orderBy("chunk")).alias("end"))
    first = by_chunk(key, time)
    rows = rows.withColumns({"within": F.lag(column).over(first), "place": F.row_number().over(first)}).join(ends, [key, "chunk"])
    return rows.withColumn("previous", F.when(F.col("place") > 1, F.col("within")).otherwise(F.col("end"))).drop("chunk", "within", "place", "end")
