"""Incremental feeds: folders with a manifest, read when newer than the last good run."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialize

# Manifest file and its field.
MANIFEST_FILE = "manifest-files.json"
DATA_KEY_FIELD = "dataFileS3Key"


@dataclass(frozen=True)
class Bounds:
    """What bounds a listing from below once there is a mark, so that a run does not list the feed's history.

    ``days``: the feed has a level of day folders above its folders, named by this ``strftime`` pattern (it
    may hold slashes), in UTC. Only the days from ``lookback_days`` before the mark until tomorrow are listed;
    a manifest that comes to an earlier day later than that is not found. Works in any store.
    ``folder_times``: the store changes a folder's time when a manifest is put there or replaced, as HDFS
    and POSIX file systems do (object stores don't). The names below the root are listed, but only folders with a
    time from the mark on are looked into. A manifest rewritten in place is not found.
    """

    days: str | None = None
    lookback_days: int = 1
    folder_times: bool = False


def watermark(
    control: DataFrame,
    job_name: str,
    watermark_column: str = "load_start_time",
    condition: str = "load_status = 'Success'",
) -> datetime | None:
    """Start of the last successful run. Partial and failed runs do not move the mark."""
    row = (
        control.where(F.col("job_name") == job_name)
        .where(condition)
        .agg(F.date_format(F.max(watermark_column), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("mark"))
        .first()
    )
    return datetime.fromisoformat(row["mark"]) if row and row["mark"] else None


def discover(
    spark: SparkSession,
    root: str,
    newer_than: datetime | None = None,
    manifest_file: str = MANIFEST_FILE,
    data_key_field: str = DATA_KEY_FIELD,
    key_root: str | None = None,
    bounds: Bounds = Bounds(),
) -> DataFrame:
    """Data files named by the manifests below ``root/*/``: (folder, manifest_time, data_file).

    Only manifests modified after ``newer_than`` count; Spark opens no older one, and with ``bounds`` lists
    none that cannot be newer. A key that is not a whole path, as object stores list them, is taken
    below ``key_root`` (the bucket). With day folders a folder's name begins with its day.
    """
    key = F.col(data_key_field)
    if key_root is not None:
        whole = key.rlike("^(/|[a-z0-9]+:/)")
        key = F.when(whole, key).otherwise(F.concat(F.lit(key_root.rstrip("/") + "/"), key))
    schema = T.StructType([T.StructField(data_key_field, T.StringType())])
    paths = _manifest_paths(spark, root.rstrip("/"), manifest_file, newer_than, bounds)
    if not paths:
        return spark.createDataFrame([], "folder STRING, data_file STRING, manifest_time TIMESTAMP")
    above = bounds.days.count("/") + 1 if bounds.days else 0
    manifests = (
        spark.read.schema(schema)
        .json(paths)
        .select(
            F.regexp_extract(
                F.url_decode(F.regexp_replace(F.col("_metadata.file_path"), r"\+", "%2B")),
                rf"((?:[^/]+/){{{above}}}[^/]+)/\Q{manifest_file}\E",
                1,
            ).alias("folder"),
            F.col("_metadata.file_modification_time").alias("manifest_time"),
            key.alias("data_file"),
        )
        .where(F.col("data_file").isNotNull())
    )
    if newer_than is not None:
        mark = newer_than.isoformat(sep=" ")
        manifests = manifests.where(F.col("manifest_time") > F.lit(mark).cast("timestamp"))
    return manifests.groupBy("folder", "data_file").agg(
        F.max("manifest_time").alias("manifest_time")
    )


def _manifest_paths(
    spark: SparkSession, root: str, manifest_file: str, newer_than: datetime | None, bounds: Bounds
) -> list[str]:
    """Paths to read, as globs or one for each folder that may have news."""
    make = spark._jvm.org.apache.hadoop.fs.Path
    system = make(root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if newer_than is None or not (bounds.days or bounds.folder_times):
        return [f"{root}/{'*/' * (bounds.days.count('/') + 1) if bounds.days else ''}*/{manifest_file}"]
    mark = newer_than if newer_than.tzinfo else newer_than.replace(tzinfo=timezone.utc)
    if bounds.days:
        day, last = mark - timedelta(days=bounds.lookback_days), datetime.now(timezone.utc) + timedelta(days=1)
        names = []
        while day.date() <= last.date():
            names.append(day.strftime(bounds.days))
            day += timedelta(days=1)
        folders = [f"{root}/{name}" for name in dict.fromkeys(names) if system.exists(make(f"{root}/{name}"))]
        globs = [f"{_literal(folder)}/*/{manifest_file}" for folder in folders]
        return [g for g in globs if len(system.globStatus(make(g)))]
    # Some stores keep whole seconds only.
    since = int(mark.timestamp() * 1000) - 1000
    entries = [e for e in system.listStatus(make(root)) if e.isDirectory() and e.getModificationTime() >= since]
    held = [make(e.getPath(), manifest_file) for e in entries]
    return [_literal(path.toString()) for path in held if system.exists(path)]


def _literal(path: str) -> str:
    """A path that names itself where globs are read."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def stored_files(
    spark: SparkSession, paths: str | list[str], glob: str = "*.json.gz"
) -> DataFrame:
    """Files that exist below ``paths``; the listing is read, the contents are not."""
    return (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", True)
        .option("pathGlobFilter", glob)
        .load(paths)
        .select(F.col("path").alias("data_file"), F.col("length").alias("bytes"))
    )


def present_and_missing(discovered: DataFrame, root: str) -> DataFrame:
    """The discovered files with ``bytes``; NULL marks a file that is named but absent.

    Only the discovered folders are listed, not the history of the feed. The list is written
    first, so that a manifest that arrives meanwhile waits for the next run.
    """
    spark = discovered.sparkSession
    discovered = materialize(discovered, "manifests")
    names = [r["folder"] for r in discovered.select("folder").distinct().collect()]
    if not names:
        return discovered.withColumn("bytes", F.lit(None).cast("bigint"))
    stored = stored_files(spark, [_literal(f"{root}/{name}") for name in sorted(names)])
    sizes = stored.select(_path("data_file").alias("__path"), "bytes")
    return (
        discovered.withColumn("__path", _path("data_file"))
        .join(sizes, "__path", "left")
        .drop("__path")
    )


def file_list(files: DataFrame) -> list[str]:
    """The paths to hand to a reader: one short string per file, as Spark's own file index
    keeps them on the driver. No data passes here."""
    rows = files.where(F.col("bytes").isNotNull()).select("data_file").distinct().collect()
    return sorted(r["data_file"] for r in rows)


def _path(column: str):
    """A path without its scheme, so that ``file:/a`` and ``/a`` are the same file."""
    return F.regexp_replace(F.col(column), r"^[a-z0-9]+:/+", "/")
