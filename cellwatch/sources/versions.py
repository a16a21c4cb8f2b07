"""Tables whose content changes at one instant: data goes to new folders, and a numbered manifest names the folders that make up a version.

A commit writes its rows first, which nothing reads yet, then the manifest under a name that no reader looks at, and renames that to the next number; the
rename fails if another writer took the number. A job that ends in between leaves the last version whole, and its folders to ``vacuum``.
Partition folders of the last version are taken over by name, so replacing some dates rewrites only these. A manifest has one
line for each partition, none for files.
"""

from __future__ import annotations

import itertools
import json
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

_COLUMN = "_version"


class ConflictError(RuntimeError):
    """Another writer committed the same version first."""


def work_folder(spark: SparkSession, name: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; where that is unset, in /tmp on one machine, and an error on a cluster."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "/tmp/checkpoints"
    return f"{root.rstrip('/')}/cellwatch-{name}-{uuid.uuid4().hex}"


class VersionedTable:
    """A table at ``path``; ``by`` are the columns of its partitions, which commits may replace one by one."""

    def __init__(self, spark: SparkSession, path: str, by: tuple[str, ...] = ()) -> None:
        self.spark, self.path, self.by = spark, path.rstrip("/"), tuple(by)
        self._fs = spark._jvm.org.apache.hadoop.fs
        self._conf = spark._jsparkSession.sessionState().newHadoopConf()
        self._store = self._at().getFileSystem(self._conf)

    def _at(self, *parts: str):
        return self._fs.Path("/".join((self.path, *parts)))

    def _read_text(self, path) -> str:
        stream = self._store.open(path)
        try:
            return self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def _write_text(self, path, text: str) -> None:
        stream = self._store.create(path, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def versions(self) -> list[int]:
        folder = self._at("_versions")
        if not self._store.exists(folder):
            return []
        names = (f.getPath().getName() for f in self._store.listStatus(folder))
        return sorted(int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def manifest(self, version: int | None = None) -> dict | None:
        """``{version, schema, parts}`` of a version, by default the last one; null for a table without any."""
        found = self.versions()
        if version is None:
            version = found[-1] if found else None
        elif version not in found:
            raise LookupError(f"no version {version} of {self.path}")
        return None if version is None else json.loads(self._read_text(self._at("_versions", f"{version:012d}.json")))

    def read(self, version: int | None = None) -> DataFrame:
        """A version's rows, by default the last one's, fixed at this call. A table without versions is an error."""
        told = self.manifest(version)
        if told is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return self._rows(told["schema"], told["parts"])

    def _folder(self, part: str, own: str) -> str:
        return f"{self.path}/data/{'/'.join(filter(None, (part, f'{_COLUMN}={own}')))}"

    def _rows(self, schema: dict, parts: dict[str, str]) -> DataFrame:
        kind = T.StructType.fromJson(schema)
        if not parts:
            return self.spark.createDataFrame([], kind)
        full = T.StructType([*kind.fields, T.StructField(_COLUMN, T.StringType())])
        return self.spark.read.schema(full).option("basePath", f"{self.path}/data").parquet(*(self._folder(*x) for x in parts.items())).select(*kind.names)

    def write(self, df: DataFrame) -> dict[str, str]:
        """The rows in new folders, by partition; no reader sees them before a commit."""
        own = uuid.uuid4().hex
        df.withColumn(_COLUMN, F.lit(own)).write.partitionBy(*self.by, _COLUMN).mode("append").parquet(f"{self.path}/data")
        found = self._store.globStatus(self._at("data", *("*" for _ in self.by), f"{_COLUMN}={own}")) or []
        depth = len(self.by)
        names = ([p.getName() for p in reversed(list(_parents(f.getPath(), depth)))] for f in found)
        return {"/".join(n): own for n in names}

    def _claim(self, version: int, told: dict) -> None:
        aside = self._at("_versions", f".{uuid.uuid4().hex}")
        self._write_text(aside, json.dumps(told))
        self._rename(aside, self._at("_versions", f"{version:012d}.json"))

    def _rename(self, source, target) -> None:
        context = self._fs.FileContext.getFileContext(self._store.getUri(), self._conf)
        never_over = self.spark.sparkContext._gateway.new_array(self._fs.Options.Rename, 0)
        try:
            context.rename(source, target, never_over)
        except Exception as e:  # py4j wraps the store's error
            if "AlreadyExists" not in str(e):
                raise
            self._store.delete(source, False)
            raise ConflictError(f"{target} was committed by another writer") from e

    def commit(self, df: DataFrame, keep_others: bool = False) -> int:
        """Make ``df`` the table, or with ``keep_others`` only its partitions, and return the new version.

        ``df`` may read the table itself. Versions before stay readable until ``vacuum``.
        """
        last = self.manifest()
        parts = self.write(df)
        if keep_others and last is not None:
            parts = last["parts"] | parts
        version = 1 if last is None else last["version"] + 1
        self._claim(version, {"version": version, "schema": json.loads(df.schema.json()), "parts": parts})
        return version

    def layout(self) -> DataFrame:
        """``(part, files, bytes)`` of the last version's partitions, from the files' listing; contents are not read."""
        told = self.manifest()
        if told is None:
            raise FileNotFoundError(f"no version of {self.path}")
        schema = "part string, files bigint, bytes bigint"
        if not told["parts"]:
            return self.spark.createDataFrame([], schema)
        files = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load([self._folder(*x) for x in told["parts"].items()]).select("path", "length")
        part = F.regexp_extract("path", rf"/data/(.*?)/?{_COLUMN}=[0-9a-f]+/", 1)
        return files.groupBy(part.alias("part")).agg(F.count("*").alias("files"), F.sum("length").alias("bytes"))

    def compact(self, target_bytes: int = 128 << 20) -> int | None:
        """Rewrite the partitions that have more files than their bytes need, as files of about the target size; the new version, or null if there was nothing to do.

        Rows stay the same. A partition's rows are dealt by their hash to as many shares as it needs files, so no task holds a large partition, and each share has a task
        of its own, so no two become one file beyond the target.
        """
        need = F.greatest(F.ceil(F.col("bytes") / target_bytes), F.lit(1)).cast("int")
        crowded = self.layout().withColumn("need", need).where("files > need").select("part", "need").collect()  # a row for each partition, as in the manifest
        if not crowded:
            return None
        last = self.manifest()
        needs = {r.part: r.need for r in crowded}
        rows = self._rows(last["schema"], {p: last["parts"][p] for p in needs})
        at = F.concat_ws("/", *(F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("__HIVE_DEFAULT_PARTITION__"))) for c in self.by)) if self.by else F.lit("")
        firsts = itertools.accumulate(needs.values(), initial=0)
        shares = self.spark.createDataFrame([(*x, n) for x, n in zip(needs.items(), firsts)], "_part string, _need int, _first int")
        slot = (F.coalesce("_first", F.lit(0)) + F.pmod(F.xxhash64(*rows.columns), F.coalesce("_need", F.lit(1)))).cast("int")
        dealt = rows.withColumn("_part", at).join(F.broadcast(shares), "_part", "left").withColumn("_slot", slot)
        parts = last["parts"] | self.write(dealt.repartitionById(sum(needs.values()), "_slot").select(*rows.columns))
        self._claim(last["version"] + 1, {"version": last["version"] + 1, "schema": last["schema"], "parts": parts})
        return last["version"] + 1

    def vacuum(self, keep: int = 2) -> int:
        """Delete versions but the last ``keep``, and all folders that these don't name; run it while no commit is under way."""
        found = self.versions()
        for version in found[:-keep]:
            self._store.delete(self._at("_versions", f"{version:012d}.json"), False)
        needed = {(part, own) for v in found[-keep:] for part, own in self.manifest(v)["parts"].items()}
        gone = 0
        for f in self._store.globStatus(self._at("data", *("*" for _ in self.by), f"{_COLUMN}=*")) or []:
            names = [p.getName() for p in reversed(list(_parents(f.getPath(), len(self.by))))]
            if ("/".join(names), f.getPath().getName().partition("=")[2]) not in needed:
                self._store.delete(f.getPath(), True)
                gone += 1
        return gone


def _parents(path, n: int) -> Iterator:
    for _ in range(n):
        path = path.getParent()
        yield path


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The last version of a table that ``publish``, ``refresh`` or ``replace_snapshot`` wrote."""
    return VersionedTable(spark, path).read()
