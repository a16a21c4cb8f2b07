"""Readers of raw activity and geometry, and writers of the layers."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from cellwatch.functions.expressions import MEASURES, TOTALS
from cellwatch.sources.content import content_differences
from cellwatch.sources.versions import VersionedTable

#: Fixed value: names of the city's daily files.
FILE_GLOB = "sms-call-internet-mi-[0-9][0-9][0-9][0-9]-[0-9][0-9]-[0-9][0-9].csv"
CORRUPT = "_corrupt_record"
RAW_SCHEMA = T.StructType(
    [T.StructField("datetime", T.StringType()), T.StructField("CellID", T.IntegerType()), T.StructField("countrycode", T.IntegerType())]
    + [T.StructField(c, T.DoubleType()) for c in ("smsin", "smsout", "callin", "callout", "internet")]
)
HOURLY_COLUMNS = ["grid_id", "timestamp", *MEASURES, "date", "hour", *TOTALS]
_GEOJSON = "features array<struct<id:int,properties:struct<cellId:int>,geometry:struct<type:string,coordinates:array<array<array<double>>>>>>"


def read_activity(spark: SparkSession, path: str) -> DataFrame:
    """All daily files of a folder by their declared schema; a file with other columns, or no file at all, is an error.

    A row with a cell that doesn't fit its type keeps its text in ``_corrupt_record``, whichever columns are used later.
    """
    names = spark.read.format("binaryFile").option("pathGlobFilter", FILE_GLOB).load(path).select("path")
    if names.isEmpty():
        raise FileNotFoundError(f"no daily activity files in {path}")
    # read as text and cast here: Spark's reader would look only at the columns that are used later, and call a row sound by these
    schema = T.StructType([*(T.StructField(f.name, T.StringType()) for f in RAW_SCHEMA), T.StructField(CORRUPT, T.StringType())])
    rows = spark.read.schema(schema).option("header", True).option("enforceSchema", False).option("columnNameOfCorruptRecord", CORRUPT).option("pathGlobFilter", FILE_GLOB).csv(path)
    cast = {f.name: F.col(f.name).try_cast(f.dataType) for f in RAW_SCHEMA}
    odd = reduce(or_, (F.col(c).isNotNull() & x.isNull() for c, x in cast.items()))
    text = F.concat_ws(",", *(F.coalesce(c, F.lit("")) for c in RAW_SCHEMA.names))
    return rows.select(*(x.alias(c) for c, x in cast.items()), F.coalesce(CORRUPT, F.when(odd, text)).alias(CORRUPT))


def with_source_file(df: DataFrame) -> DataFrame:
    """Name of the file that each row was read from."""
    return df.withColumn("source_file", F.col("_metadata.file_name"))


def read_grid_geometry(spark: SparkSession, path: str) -> DataFrame:
    """``(grid_id, ring, geometry_json)`` of a GeoJSON feature collection, keyed by the 1-based ``cellId``."""
    features = spark.read.schema(_GEOJSON).option("multiLine", True).json(path).select(F.explode("features").alias("f"))
    geometry = F.col("f.geometry")
    return features.select(F.col("f.properties.cellId").alias("grid_id"), geometry["coordinates"][0].alias("ring"), F.to_json(geometry).alias("geometry_json"))


def write_processed(clean: DataFrame, path: str) -> None:
    """Clean rows, a folder per date; only the dates in ``clean`` are replaced."""
    clean.write.partitionBy("date").option("partitionOverwriteMode", "dynamic").mode("overwrite").parquet(path)


def write_hourly(hourly: DataFrame, path: str) -> None:
    """The hourly fact, without geometry."""
    hourly.select(*HOURLY_COLUMNS).write.mode("overwrite").parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    """A small table as one CSV file."""
    df.coalesce(1).write.option("header", True).mode("overwrite").csv(path)


def write_run_metrics(df: DataFrame, path: str) -> None:
    """A run's measures as JSON, one row for each run that it gets."""
    df.coalesce(1).write.mode("overwrite").json(path)


def append_audit(records: DataFrame, path: str) -> None:
    """Audit records are only ever added."""
    records.write.mode("append").json(path)


def verify_roundtrip(df: DataFrame, path: str, keys: tuple[str, ...] = ("grid_id", "timestamp"), by: tuple[str, ...] = ("date",)) -> DataFrame:
    """One row: whether what was written is what is read, by content, counts, columns, unique keys and the absence of geometry.

    ``changed`` lists the partitions whose rows differ; it is null, and nothing is sound, where the columns differ already.
    """
    back = df.sparkSession.read.parquet(path)
    d = back.groupBy(*keys).agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("duplicate_keys"))
    same = sorted((f.name, f.dataType.simpleString()) for f in df.schema) == sorted((f.name, f.dataType.simpleString()) for f in back.schema)
    plain = not any("geometry" in c for c in back.columns)
    if same:
        name = F.concat_ws("/", *(F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in by))
        told = content_differences(df, back, by).agg(
            F.coalesce(F.sum("rows_a"), F.lit(0)).alias("written_rows"), F.coalesce(F.sum("rows_b"), F.lit(0)).alias("read_rows"), F.sort_array(F.collect_list(F.when(~F.col("same"), name))).alias("changed")
        )
    else:
        told = df.agg(F.count("*").alias("written_rows")).crossJoin(back.agg(F.count("*").alias("read_rows"))).withColumn("changed", F.lit(None).cast("array<string>"))  # one row each
    out = told.crossJoin(d).withColumns({"same_schema": F.lit(same), "no_geometry": F.lit(plain)})  # one row each
    return out.withColumn("sound", F.coalesce(F.size("changed") == 0, F.lit(False)) & (F.col("duplicate_keys") == 0) & F.col("same_schema") & F.col("no_geometry"))


def union_partitions(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Folders of single dates read by hand: the date is put back and the parts are united by name."""
    out = None
    for date, path in sorted(paths.items()):
        part = spark.read.parquet(path).withColumn("date", F.lit(date))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise ValueError("no partitions given")
    return out


def layer_sizes(spark: SparkSession, layers: dict[str, str], raw: str = "raw") -> DataFrame:
    """Files and bytes of each layer, and its share of the raw one; contents are not read."""
    out = None
    for name, path in layers.items():
        part = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select(F.lit(name).alias("layer"), "length")
        out = part if out is None else out.union(part)
    sums = out.groupBy("layer").agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))
    base = sums.where(F.col("layer") == raw).select(F.col("bytes").alias("raw_bytes"))
    return sums.join(F.broadcast(base), how="cross").withColumn("ratio", F.col("bytes") / F.col("raw_bytes")).drop("raw_bytes")  # one row


def replace_snapshot(df: DataFrame, path: str, column: str = "timestamp") -> int:
    """Put a snapshot in place of the stored one of the same time, in one commit; others stay, and doing it again changes nothing. Read by ``read_table``."""
    told = df.withColumn("snapshot", F.date_format(column, "yyyyMMddHHmmss"))
    return VersionedTable(df.sparkSession, path, ("snapshot",)).commit(told, keep_others=True)


def publish(base_path: str, updates: DataFrame, keys: tuple[str, ...] = ("grid_id", "timestamp")) -> int:
    """Upsert into a stored fact by date, in one commit; only the dates of ``updates`` are written again. Read by ``read_table``."""
    from cellwatch.operators.warehouse import upsert

    table = VersionedTable(updates.sparkSession, base_path, ("date",))
    if table.manifest() is None:
        return table.commit(updates)
    base = table.read().join(updates.select("date").distinct(), "date", "left_semi")
    return table.commit(upsert(base, updates, keys), keep_others=True)


def refresh(df: DataFrame, path: str) -> int:
    """Replace a derived table, which ``df`` may read, in one commit. Read by ``read_table``."""
    return VersionedTable(df.sparkSession, path).commit(df)
