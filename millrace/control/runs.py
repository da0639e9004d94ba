"""Run control and audit: control record, file tracking, counters, folder outcomes, summary."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators.quality import QualityError
from millrace.sources.files import CORRUPT

SUCCESS, PARTIAL, FAILED = "Success", "Partial", "Failed"

# The fields of the control table and of the file-tracking table.
CONTROL_SCHEMA = T.StructType(
    [
        T.StructField("job_name", T.StringType()),
        T.StructField("source_data", T.StringType()),
        T.StructField("source_database", T.StringType()),
        T.StructField("source_table", T.StringType()),
        T.StructField("target_layer", T.StringType()),
        T.StructField("target_database", T.StringType()),
        T.StructField("target_table", T.StringType()),
        T.StructField("source_count", T.LongType()),
        T.StructField("target_count", T.LongType()),
        T.StructField("load_date", T.DateType()),
        T.StructField("load_status", T.StringType()),
        T.StructField("load_start_time", T.TimestampType()),
        T.StructField("load_end_time", T.TimestampType()),
        T.StructField("job_run_time", T.DoubleType()),
        T.StructField("created_on", T.TimestampType()),
    ]
)
TRACKING_SCHEMA = T.StructType(
    [
        T.StructField("job_name", T.StringType()),
        T.StructField("s3_file_path", T.StringType()),
        T.StructField("file_read_timestamp", T.TimestampType()),
        T.StructField("raw_count", T.LongType()),
        T.StructField("created_on", T.TimestampType()),
    ]
)


def control_record(
    spark: SparkSession,
    job_name: str,
    source_count: int,
    target_count: int,
    load_status: str,
    started: datetime,
    ended: datetime,
    load_date: date,
    **names: str,
) -> DataFrame:
    """The one-row record of a run. Times carry a time zone."""
    values: dict[str, Any] = {
        "job_name": job_name,
        "source_count": source_count,
        "target_count": target_count,
        "load_date": load_date,
        "load_status": load_status,
        "load_start_time": started,
        "load_end_time": ended,
        "job_run_time": (ended - started).total_seconds(),
        "created_on": ended,
        **names,
    }
    unknown = set(values) - set(CONTROL_SCHEMA.fieldNames())
    if unknown:
        raise ValueError(f"not control fields: {', '.join(sorted(unknown))}")
    return spark.createDataFrame(
        [tuple(values.get(f) for f in CONTROL_SCHEMA.fieldNames())], CONTROL_SCHEMA
    )


def append_record(record: DataFrame, path: str) -> None:
    record.coalesce(1).write.mode("append").parquet(path)


def read_control(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CONTROL_SCHEMA).parquet(path)


def create_tables(spark: SparkSession, control_path: str, tracking_path: str) -> None:
    """Empty control and tracking tables where there are none yet."""
    for path, schema in ((control_path, CONTROL_SCHEMA), (tracking_path, TRACKING_SCHEMA)):
        spark.createDataFrame([], schema).write.mode("ignore").parquet(path)


def read_tracking(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TRACKING_SCHEMA).parquet(path)


def untracked(files: DataFrame, tracking: DataFrame) -> DataFrame:
    """The listed files that no earlier run has loaded."""
    known = tracking.select(file_name("s3_file_path").alias("__name")).distinct()
    return (
        files.withColumn("__name", file_name("data_file"))
        .join(known, "__name", "left_anti")
        .drop("__name")
    )


def file_tracking(
    raw: DataFrame, job_name: str, read_at: datetime, read: DataFrame | None = None
) -> DataFrame:
    """One row per file read, with its raw record count. ``read`` lists (data_file) all of them,
    so that a file without a record is tracked too."""
    stamp = F.lit(read_at)
    counts = raw.groupBy(F.col("source_file").alias("s3_file_path")).agg(F.count(F.lit(1)).alias("raw_count"))
    if read is not None:
        files = read.select("data_file", file_name("data_file").alias("__name")).dropDuplicates(["__name"])
        counts = files.join(
            counts.select(file_name("s3_file_path").alias("__name"), "raw_count"), "__name", "left"
        ).select(F.col("data_file").alias("s3_file_path"), F.coalesce("raw_count", F.lit(0)).alias("raw_count"))
    return (
        counts.withColumns(
            {
                "job_name": F.lit(job_name),
                "file_read_timestamp": stamp,
                "created_on": stamp,
            }
        )
        .select(*TRACKING_SCHEMA.fieldNames())
    )


def counters(
    marked: DataFrame,
    early_reasons: Sequence[str],
    group_by: Sequence[str] = (),
    reason: str = "reject_reason",
    weight: str | None = None,
) -> DataFrame:
    """raw, eligible, processed and skipped counts in one pass over the reject reasons.

    A record is eligible unless one of ``early_reasons`` (the checks on the record itself)
    rejected it, and processed when nothing did. ``weight`` names the record count of rows
    that are counted already.
    """
    early = F.coalesce(F.col(reason).isin(list(early_reasons)), F.lit(False))
    one = F.lit(1) if weight is None else F.col(weight)

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, one)), F.lit(0)).cast("bigint")

    return marked.groupBy(*group_by).agg(
        total(F.lit(True)).alias("raw_count"),
        total(~early).alias("eligible_count"),
        total(F.col(reason).isNull()).alias("processed_count"),
        total(F.col(reason).isNotNull()).alias("skipped_count"),
    )


def folder_outcomes(files: DataFrame, raw: DataFrame, unreadable: Sequence[str] = ()) -> DataFrame:
    """Status per folder from one distributed pass: no loop over folders on the driver.

    ``files`` lists (folder, data_file, bytes) with NULL bytes for an absent file; ``raw`` is
    the landed read of the present ones and ``unreadable`` names the folders it lacks
    (``sources.files.land_folders``). A folder fails when a file is absent or it is unreadable; the
    other folders go on. A readable file without a record is good.
    """
    per_source = raw.groupBy("source_file").agg(
        F.count(F.lit(1)).alias("raw_count"),
        F.count_if(F.col(CORRUPT).isNotNull()).alias("corrupt_count"),
    )
    per_file = per_source.groupBy(file_name("source_file").alias("__name")).agg(
        F.sum("raw_count").alias("raw_count"), F.sum("corrupt_count").alias("corrupt_count")
    )
    unread = F.col("bytes").isNull() | F.col("folder").isin(list(unreadable))
    return (
        files.withColumn("__name", file_name("data_file"))
        .join(per_file, "__name", "left")
        .groupBy("folder")
        .agg(
            F.count(F.lit(1)).alias("files"),
            F.count_if(unread).alias("failed_files"),
            F.coalesce(F.sum("raw_count"), F.lit(0)).alias("raw_count"),
            F.coalesce(F.sum("corrupt_count"), F.lit(0)).alias("corrupt_count"),
        )
        .withColumn("status", F.when(F.col("failed_files") > 0, FAILED).otherwise(SUCCESS))
    )


def run_status(folders: DataFrame, status: str = "status") -> Column:
    """Aggregate expression: Success, Partial (some folders failed) or Failed (all did)."""
    failed = F.count_if(F.col(status) == FAILED)
    return (
        F.when(failed == 0, SUCCESS).when(failed == F.count(F.lit(1)), FAILED).otherwise(PARTIAL)
    )


def exit_code(load_status: str) -> int:
    """0 only for a run without a failed folder."""
    return 0 if load_status == SUCCESS else 1


def run_summary(per_folder: DataFrame, target_count: int) -> DataFrame:
    """The seven closing totals, from one row per folder with its status and counters."""
    return per_folder.agg(
        F.count(F.lit(1)).alias("folders_processed"),
        F.count_if(F.col("status") == FAILED).alias("failed_folders"),
        F.sum("raw_count").cast("bigint").alias("total_raw_count"),
        F.sum("eligible_count").cast("bigint").alias("total_eligible"),
        F.sum("processed_count").cast("bigint").alias("total_processed"),
        F.sum("skipped_count").cast("bigint").alias("total_skipped"),
        F.lit(target_count).cast("bigint").alias("total_target_count"),
    )


def status_check(control: DataFrame, expected: Sequence[str] = (SUCCESS, PARTIAL)) -> DataFrame:
    """After the load: every run's status against the expected ones."""
    ok = F.coalesce(F.col("load_status").isin(list(expected)), F.lit(False))
    return control.select("job_name", "load_status", ok.alias("passed"))


def count_check(control: DataFrame) -> DataFrame:
    """After the load: rows reached the target whenever the source had any; else a warning."""
    ok = (F.col("source_count") == 0) | (F.col("target_count") > 0)
    return control.select(
        "job_name", "source_count", "target_count", F.coalesce(ok, F.lit(False)).alias("passed")
    )


def require_status(control: DataFrame) -> None:
    """Raise when a run neither succeeded nor partly succeeded."""
    bad = status_check(control).where(~F.col("passed")).limit(1).collect()
    if bad:
        raise QualityError(f"run {bad[0].job_name} ended {bad[0].load_status}")


def file_name(column: str) -> Column:
    """File path without its scheme, so that ``file:/a`` and ``/a`` are the same file."""
    return F.regexp_replace(F.col(column), r"^[a-z0-9]+:/+", "/")
