"""Cell geometry: centroids, key checks, enrichment and the map layer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cellwatch.functions.expressions import GRID_MAX, GRID_MIN

#: Up to so many cells, geometry is sent to all executors; more are joined by a shuffle.
BROADCAST_CELLS = 50_000
NEAR_MIN, NEAR_MAX = 0.0001, 0.05


def centroid(ring: Column | str) -> tuple[Column, Column]:
    """(lat, lon): mean of the ring's points, the closing one counted again."""
    ring = F.col(ring) if isinstance(ring, str) else ring
    mean = lambda i: F.aggregate(ring, F.lit(0.0), lambda acc, p: acc + F.get(p, F.lit(i))) / F.nullif(F.size(ring), F.lit(0))
    return mean(1), mean(0)


def build_dim_grid(geometry: DataFrame) -> DataFrame:
    """Dimension of ``geometry(grid_id, ring, geometry_json)``."""
    lat, lon = centroid("ring")
    return geometry.select("grid_id", lat.alias("centroid_lat"), lon.alias("centroid_lon"), "geometry_json")


def check_geometry_keys(geometry: DataFrame, first: int = GRID_MIN, last: int = GRID_MAX) -> DataFrame:
    """One row: whether the ids are unique and span first..last without a gap."""
    out = geometry.agg(F.count("*").alias("cells"), F.countDistinct("grid_id").alias("distinct_cells"), F.min("grid_id").alias("least"), F.max("grid_id").alias("largest"))
    whole = (F.col("cells") == F.col("distinct_cells")) & (F.col("least") == first) & (F.col("largest") == last) & (F.col("cells") == last - first + 1)
    return out.withColumn("sound", F.coalesce(whole, F.lit(False)))


def check_adjacency(dim_grid: DataFrame, per_row: int = 100, box: tuple[float, float, float, float] = (8.9, 45.3, 9.4, 45.6)) -> DataFrame:
    """Cells that lie outside the city's box or not next to the cell of the following id; ends of rows have no such neighbour."""
    a = dim_grid.select("grid_id", "centroid_lat", "centroid_lon")
    b = a.select((F.col("grid_id") - 1).alias("grid_id"), F.col("centroid_lat").alias("lat2"), F.col("centroid_lon").alias("lon2"))
    far = F.sqrt(F.pow(F.col("centroid_lat") - F.col("lat2"), F.lit(2)) + F.pow(F.col("centroid_lon") - F.col("lon2"), F.lit(2)))
    out = a.join(b, "grid_id", "left").withColumn("distance", far)
    apart = (F.col("grid_id") % per_row != 0) & F.col("distance").isNotNull() & ~((F.col("distance") > NEAR_MIN) & (F.col("distance") < NEAR_MAX))
    inside = F.col("centroid_lon").between(box[0], box[2]) & F.col("centroid_lat").between(box[1], box[3])
    return out.where(apart | ~inside).select("grid_id", "distance", inside.alias("in_city"))


def enrich_geometry(hourly: DataFrame, geometry: DataFrame) -> DataFrame:
    """Hourly rows with geometry where there is one; its size is checked before it is broadcast."""
    geometry = geometry.select("grid_id", "geometry_json")
    few = geometry.limit(BROADCAST_CELLS + 1).count() <= BROADCAST_CELLS
    return hourly.join(F.broadcast(geometry) if few else geometry, "grid_id", "left")


def join_coverage(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """One row: whether a left join on the key keeps the row count, which keys it leaves unmatched, and the share of rows matched."""
    keys = right.groupBy(key).agg(F.count("*").alias("copies"))
    counts = left.groupBy(key).agg(F.count("*").alias("rows"))
    both = counts.join(keys, key, "left")
    return both.agg(
        F.sum("rows").alias("rows"),
        F.sum(F.col("rows") * F.coalesce("copies", F.lit(1))).alias("joined_rows"),
        F.count_if(F.col("copies").isNull()).alias("unmatched_keys"),
        (F.coalesce(F.sum(F.when(F.col("copies").isNotNull(), F.col("rows"))), F.lit(0)) * 100.0 / F.nullif(F.sum("rows"), F.lit(0))).alias("coverage_pct"),
    ).withColumn("rows_unchanged", F.col("rows") == F.col("joined_rows"))


def unmatched_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.select(key).distinct().join(right.select(key), key, "left_anti")


def map_layer(hotspots: DataFrame, alerts: DataFrame, geometry: DataFrame) -> DataFrame:
    """Cells to draw, alerts as ``attention`` before hotspots as ``high``, with their ring and its bounding box."""
    ids = hotspots.select("grid_id").union(alerts.select("grid_id")).distinct()
    marked = ids.join(alerts.select("grid_id", F.lit(True).alias("alerted")).distinct(), "grid_id", "left")
    out = marked.join(geometry.select("grid_id", "ring"), "grid_id", "left")
    axis = lambda i: F.transform("ring", lambda p: F.get(p, F.lit(i)))
    return out.select(
        "grid_id", F.when(F.col("alerted"), "attention").otherwise("high").alias("state"), "ring",
        F.array_min(axis(0)).alias("min_lon"), F.array_min(axis(1)).alias("min_lat"), F.array_max(axis(0)).alias("max_lon"), F.array_max(axis(1)).alias("max_lat"),
    )
