"""Daily files from a stream, each judged whole by the gate before any of its rows reach the fact.

A micro-batch of the file source holds whole files. The gate's verdicts on it go to an audit table, which is the stream's memory of accepted names; the
accepted files' rows are cleaned, summed by hour and upserted. The fact is published before the audit: if the job ends in between,
the batch comes again, is judged as before, since only other batches' records count, and its upsert changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import DataStreamWriter

from cellwatch.operators.aggregate import hourly_grid_summary
from cellwatch.operators.clean import clean
from cellwatch.sources.activity import FILE_GLOB, publish
from cellwatch.sources.gate import headers_of, quality_of, raw_rows, unended, verdicts_of
from cellwatch.sources.versions import VersionedTable


def read_lines_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """``(path, name, block, value)`` of the lines of the daily files that land in a folder or below it. A file without any line never shows up here."""
    reader = spark.readStream.option("pathGlobFilter", FILE_GLOB).option("recursiveFileLookup", True)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    meta = lambda c: F.col(f"_metadata.{c}")
    return reader.text(path).select(meta("file_path").alias("path"), meta("file_name").alias("name"), meta("file_block_start").alias("block"), unended("value").alias("value"))


def take_batch(batch: DataFrame, batch_id: int, fact_path: str, audit_path: str) -> None:
    """Judge a micro-batch's files, publish the accepted ones, and record ``(path, name, status, row_count, reason, batch_id)`` of all.

    Of files of one name in a batch the one of the first path is judged, and the others are skipped as repeated.
    """
    spark = batch.sparkSession
    audit = VersionedTable(spark, audit_path, ("batch_id",))
    lines = batch.withColumn("place", F.struct("block", F.monotonically_increasing_id().alias("id"))).persist()
    try:
        paths = lines.select("path", "name").distinct()
        first = paths.groupBy("name").agg(F.min("path").alias("path"))
        judged = lines.join(F.broadcast(first), ["name", "path"], "left_semi").select("name", "value", "place")  # a row a file
        earlier = audit.read().where(F.col("batch_id") != batch_id) if audit.manifest() is not None else None
        headers = headers_of(judged, first.select("name")).persist()
        verdicts = verdicts_of(headers, quality_of(judged, headers), earlier).persist()
        if not verdicts.where(F.col("status") == "accepted").isEmpty():
            publish(fact_path, hourly_grid_summary(clean(raw_rows(judged, headers, verdicts))))
        told = first.join(verdicts, "name").select("path", "name", "status", "row_count", "reason")
        again = paths.join(first, ["name", "path"], "left_anti").select("path", "name", F.lit("skipped_duplicate").alias("status"), F.lit(0).cast("bigint").alias("row_count"), F.lit(None).cast("string").alias("reason"))
        audit.commit(told.unionByName(again).withColumn("batch_id", F.lit(batch_id).cast("bigint")), keep_others=True)
        verdicts.unpersist()
        headers.unpersist()
    finally:
        lines.unpersist()


def publish_gated_stream(lines: DataFrame, fact_path: str, audit_path: str, checkpoint: str) -> DataStreamWriter:
    """Feed the fact from ``read_lines_stream`` through the gate. Fact and audit are read by ``read_table``."""
    return lines.writeStream.option("checkpointLocation", checkpoint).foreachBatch(lambda batch, batch_id: take_batch(batch, batch_id, fact_path, audit_path))
