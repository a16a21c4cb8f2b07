"""File gate: whole files are accepted, rejected with a reason, or skipped as done before.

Files are looked at by Spark: a file that is cut into many splits still gets the verdict of its first offence. Lines are
ordered by their split's offset and their place in it; quoted line breaks and blank lines do not occur in these files.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from cellwatch.functions.expressions import RAW_NAMES, TIME_FORMAT
from cellwatch.sources.activity import FILE_GLOB, RAW_SCHEMA
from cellwatch.sources.versions import VersionedTable

REQUIRED = list(RAW_NAMES)
NUMERIC = REQUIRED[3:]
NAME_DATE = r"([0-9]{4}-[0-9]{2}-[0-9]{2})\.csv$"


def detect_files(spark: SparkSession, path: str) -> DataFrame:
    """``(name, path, length)`` of the files whose name fits, from the folder's listing; Spark's readers skip empty files."""
    glob = spark._jvm.org.apache.hadoop.fs.Path(path, FILE_GLOB)
    found = glob.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).globStatus(glob) or []
    rows = sorted((f.getPath().getName(), f.getPath().toString(), f.getLen()) for f in found)
    return spark.createDataFrame(rows, "name string, path string, length bigint")


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """``(name, value, place)`` of every line."""
    text = spark.read.option("pathGlobFilter", FILE_GLOB).text(path)
    place = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    return text.select(F.col("_metadata.file_name").alias("name"), unended("value").alias("value"), place.alias("place"))


def unended(value: str) -> Column:
    """A line without the carriage return at its end."""
    return F.when(F.col(value).contains("\r"), F.regexp_replace(value, "\r$", "")).otherwise(F.col(value))


def _unquoted(x: Column) -> Column:
    return F.trim(F.when(F.contains(x, F.lit('"')), F.regexp_replace(x, '^"|"$', "")).otherwise(x))


def _fields(value: str) -> Column:
    return F.transform(F.split(value, ","), _unquoted)


def _tops(lines: DataFrame) -> DataFrame:
    """``(name, top)``: the place of each file's first line. By split first, in longs: the least of all structs would sort the lines."""
    by_split = lines.groupBy("name", F.col("place.block").alias("block")).agg(F.min("place.id").alias("id"))
    return by_split.groupBy("name").agg(F.min(F.struct("block", "id")).alias("top"))


def check_headers(spark: SparkSession, path: str) -> DataFrame:
    """``headers_of`` the files of a folder."""
    return headers_of(_lines(spark, path), detect_files(spark, path).select("name"))


def headers_of(lines: DataFrame, files: DataFrame) -> DataFrame:
    """``(name, header, header_reason)`` of ``files(name)`` by ``lines(name, value, place)``: no reason for a header of just the
    required columns; missing columns are told before extra ones. A file without lines is empty."""
    first = lines.join(F.broadcast(_tops(lines)), "name").where(F.col("place") == F.col("top")).groupBy("name").agg(F.min("value").alias("header"))  # a row a file
    rows = files.join(first, "name", "left").withColumn("found", _fields("header"))
    need = F.array(*map(F.lit, REQUIRED))
    missing, extra = F.array_except(need, "found"), F.array_except("found", need)
    reason = (
        F.when(F.coalesce(F.trim("header"), F.lit("")) == "", "the file is empty")
        .when(F.size(missing) > 0, F.concat(F.lit("missing columns: "), F.concat_ws(", ", missing)))
        .when(F.size(extra) > 0, F.concat(F.lit("extra columns: "), F.concat_ws(", ", extra)))
        .when(F.size("found") != len(REQUIRED), F.lit("repeated columns"))
    )
    return rows.select("name", F.col("header"), reason.alias("header_reason"))


def check_quality(spark: SparkSession, path: str, headers: DataFrame | None = None) -> DataFrame:
    """``quality_of`` the files of a folder."""
    return quality_of(_lines(spark, path), check_headers(spark, path) if headers is None else headers)


def _data_lines(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """The lines after the header of files with a sound one, and the place ``at`` which each column has in that file's lines."""
    place = F.struct(*((F.array_position(_fields("header"), c) - 1).cast("int").alias(c) for c in REQUIRED))
    files = _tops(lines).join(headers.where("header_reason IS NULL").select("name", place.alias("at")), "name")
    return lines.join(F.broadcast(files), "name").where(F.col("place") > F.col("top"))  # a row a file


def _cells(rows: DataFrame) -> DataFrame:
    """``(name, place)`` and the required columns' texts; a line that ends before a column has none there.

    Each line is split once: filters on the columns, which Spark would else push to before the split and work out again, stay behind ``inline``.
    """
    cells = F.struct(*(F.coalesce(_unquoted(F.get("fields", F.col(f"at.{c}"))), F.lit("")).alias(c) for c in REQUIRED))
    return rows.withColumn("fields", F.split("value", ",")).select("name", "place", F.inline(F.array(cells)))


def raw_rows(lines: DataFrame, headers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Raw activity rows of the accepted files, by the names of their own headers."""
    accepted = verdicts.where(F.col("status") == "accepted").select("name")
    rows = _cells(_data_lines(lines, headers.join(accepted, "name", "left_semi")))
    return rows.select(*(F.nullif(F.col(f.name), F.lit("")).try_cast(f.dataType).alias(f.name) for f in RAW_SCHEMA))


def quality_of(lines: DataFrame, headers: DataFrame) -> DataFrame:
    """``(name, row_count, rows_to_first_error, quality_reason)`` from the data rows; the first offence of the first bad row counts.

    A row's checks: time format, then for each measure in order that it is a finite number and not negative; blanks are fine.
    Columns may stand in any order.
    """
    rows = _data_lines(lines, headers)
    time = F.col(REQUIRED[0])
    told = [F.when(F.try_to_timestamp(time, F.lit(TIME_FORMAT)).isNull(), F.concat(F.lit("invalid timestamp: "), time))]
    for c in NUMERIC:
        x = F.col(c)
        number = x.try_cast("double")
        finite = number.isNotNull() & ~F.isnan(number) & (F.abs(number) < float("inf"))
        told.append(F.when((x != "") & ~F.coalesce(finite, F.lit(False)), F.concat(F.lit(f"non-numeric {c}: "), x)).when((x != "") & (number < 0), F.lit(f"negative {c}")))
    judged = _cells(rows).select("name", "place", F.coalesce(*told).alias("reason"))
    # lines before the first bad one are counted in a second look that needs only its place
    bad = judged.where("reason IS NOT NULL").groupBy("name").agg(F.min(F.struct("place", "reason")).alias("b")).select("name", F.col("b.place").alias("bad_place"), F.col("b.reason").alias("quality_reason"))
    places = rows.select("name", "place").join(F.broadcast(bad), "name", "left")  # a row a file
    counts = places.groupBy("name", "quality_reason").agg(F.count("*").alias("row_count"), F.count_if(F.col("place") < F.col("bad_place")).alias("rows_to_first_error"))
    out = headers.select("name").join(counts, "name", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("row_count", "rows_to_first_error")})
    return out.select("name", "row_count", "rows_to_first_error", F.when(F.col("row_count") == 0, "the file has no data rows").otherwise(F.col("quality_reason")).alias("quality_reason"))


def drop_processed(files: DataFrame, audit: DataFrame) -> DataFrame:
    """Files that were not accepted before; rejected ones may come again."""
    return files.join(audit.where(F.col("status") == "accepted").select("name"), "name", "left_anti")


def verdicts_of(headers: DataFrame, quality: DataFrame, audit: DataFrame | None = None) -> DataFrame:
    """``(name, status, row_count, rows_to_first_error, reason)``: accepted, rejected or skipped_duplicate, for every file."""
    out = headers.select("name", "header_reason").join(quality, "name")
    done = F.lit(False)
    if audit is not None:
        out = out.join(audit.where(F.col("status") == "accepted").select("name", F.lit(True).alias("done")).distinct(), "name", "left")
        done = F.coalesce("done", F.lit(False))
    reason = F.when(~done, F.coalesce("header_reason", "quality_reason"))
    status = F.when(done, "skipped_duplicate").when(reason.isNotNull(), "rejected").otherwise("accepted")
    return out.select("name", status.alias("status"), "row_count", "rows_to_first_error", reason.alias("reason"))


def gate(spark: SparkSession, path: str, audit: DataFrame | None = None) -> DataFrame:
    """``(name, path, status, row_count, rows_to_first_error, reason)``: the verdict of every file of a folder."""
    files = detect_files(spark, path).select("name", "path")
    headers = check_headers(spark, path)
    out = files.join(verdicts_of(headers, check_quality(spark, path, headers), audit), "name")
    return out.select("name", "path", "status", "row_count", "rows_to_first_error", "reason")


def require_accepted(verdicts: DataFrame) -> DataFrame:
    """Strict runs: any rejected file is an error."""
    if not verdicts.where(~F.col("status").isin("accepted", "skipped_duplicate")).isEmpty():
        raise ValueError("some files were rejected")
    return verdicts


def audit_records(verdicts: DataFrame) -> DataFrame:
    """One record for each file that was looked at."""
    return verdicts.select("name", "status", "row_count", "reason", F.current_timestamp().alias("processed_at"))


def route(verdicts: DataFrame, accepted: str, rejected: str) -> None:
    """Copy the files, unchanged, to the zone of their verdict, by the executors; zones are folders or URIs of any file system
    that pyarrow knows. A file is copied aside and then moved, so a task that runs again leaves one whole copy."""

    def copy(rows) -> None:
        from pyarrow import fs

        for r in rows:
            source, path = fs.FileSystem.from_uri(r["path"])
            store, zone = fs.FileSystem.from_uri(accepted if r["status"] == "accepted" else rejected)
            store.create_dir(zone, recursive=True)
            aside = f"{zone}/.{r['name']}.part"  # the same in each attempt, so none is left behind
            fs.copy_files(path, aside, source_filesystem=source, destination_filesystem=store)
            store.move(aside, f"{zone}/{r['name']}")

    verdicts.where(F.col("status") != "skipped_duplicate").select("name", "path", "status").foreachPartition(copy)


def route_once(verdicts: DataFrame, accepted: str, rejected: str, manifest: str, run: str) -> DataFrame:
    """``route``, with a committed record ``(name, path, status, run)`` of each file; files that it names with the same path and status are not copied again.

    The record is written after the copies. If the job ends in between, or in the middle of the copies, the next one copies the same files
    to the same names again, so each is there once. Returns the records of all runs.
    """
    spark = verdicts.sparkSession
    table = VersionedTable(spark, manifest, ("run",))
    due = verdicts.where(F.col("status") != "skipped_duplicate").select("name", "path", "status")
    if table.manifest() is not None:
        due = due.join(table.read().select("name", "path", "status"), ["name", "path", "status"], "left_anti")
    due = due.persist()
    try:
        route(due, accepted, rejected)
        table.commit(due.withColumn("run", F.lit(run)), keep_others=True)
    finally:
        due.unpersist()
    return table.read()


def missing_dates(files: DataFrame, first: str, last: str) -> DataFrame:
    """Days of a range for which no file name has the date."""
    days = files.sparkSession.range(1).select(F.explode(F.sequence(F.lit(first).cast("date"), F.lit(last).cast("date"))).alias("date"))
    there = files.select(F.to_date(F.regexp_extract("name", NAME_DATE, 1)).alias("date"))
    return days.join(there, "date", "left_anti")


def gate_totals(verdicts: DataFrame) -> DataFrame:
    """One row: rows accepted and rejected, files of each status, and whether the run may go on."""
    of = lambda s: F.col("status") == s
    out = verdicts.agg(
        F.coalesce(F.sum(F.when(of("accepted"), F.col("row_count"))), F.lit(0)).alias("rows_accepted"), F.coalesce(F.sum(F.when(of("rejected"), F.col("row_count"))), F.lit(0)).alias("rows_rejected"),
        *(F.count_if(of(s)).alias(f"files_{s}") for s in ("accepted", "rejected", "skipped_duplicate")),
    )
    return out.withColumn("passed", F.col("files_rejected") == 0)
