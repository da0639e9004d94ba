"""The whole activation run: find new files, land, enrich, load four tables, record."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import date, datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.control import runs
from millrace.functions.images import image_schema
from millrace.operators import enrich, quality
from millrace.plans import activations
from millrace.plans.runner import Destination, prepare_load
from millrace.session import materialize, materialize_all, shared_folder, staging
from millrace.sinks import journal, tables
from millrace.sources import files, manifests

GROUP_FOLDERS = 256

# Targets with their columns, load mode and key.
TARGETS = {
    "sync_download": (
        "gcid STRING, profile_id STRING, font_style_id BIGINT, family_id INT, event_type STRING,"
        "event_date DATE, event_count BIGINT, source STRING, subtype STRING, load_date DATE",
        "append",
        (),
    ),
    "asset": (
        "asset_type STRING, project_id STRING, profile_id STRING, gcid STRING, font_style_id BIGINT,"
        "family_id INT, created_at TIMESTAMP, is_deleted BOOLEAN, asset_deleted_at TIMESTAMP",
        "insert_ignore",
        activations.ASSET_KEYS,
    ),
    "project": (
        "id STRING, name STRING, project_type STRING, profile_id STRING, gcid STRING,"
        "created_at TIMESTAMP, is_deleted BOOLEAN, project_deleted_at TIMESTAMP",
        "insert_ignore",
        ("id",),
    ),
    "usage_data": (
        "customer_id STRING, font_id BIGINT, usage_type STRING, source_system STRING,"
        "customer_identifier_type STRING, first_usage DATE, last_usage DATE, usage_count BIGINT,"
        "last_modified TIMESTAMP, year INT, month INT",
        "monthly_merge",
        (),
    ),
}


def create_targets(spark: SparkSession, names: Mapping[str, str], root: str) -> None:
    """Create the absent ones of the four tables; ``names`` gives each its catalog name."""
    for target, (columns, mode, _) in TARGETS.items():
        parts = ("year", "month") if mode == "monthly_merge" else ()
        tables.create_table(spark, names[target], columns, f"{root}/{target}", parts)


def ingest(
    spark: SparkSession,
    feed: str,
    lookups: Mapping[str, DataFrame],
    names: Mapping[str, str],
    control_path: str,
    tracking_path: str,
    load_date: date,
    job_name: str = "activations",
    key_root: str | None = None,
    clock: Callable[[], datetime] = lambda: datetime.now(timezone.utc),
    bounds: manifests.Bounds = manifests.Bounds(),
) -> DataFrame:
    """One run. Returns the closing totals in one row; the control table has the status. The
    run's stages, landing copies too, are deleted when it ends.

    A file that an earlier run has loaded and tracked is not loaded again, even when that
    run was Partial and so left the watermark where it was. A folder with an absent file makes
    the run Partial and its other files are loaded; of a folder with a damaged file nothing is
    loaded or tracked, so the next run finds it again. The four loads and the tracked files are
    one batch of the load journal beside the control table: a run that dies leaves all of them
    or none, and the next run finishes what was committed.

    Folders are landed in groups of about ``GROUP_FOLDERS``; the driver holds the names of one.
    """
    with staging(spark):
        totals = _run(spark, feed, lookups, names, control_path, tracking_path, load_date, job_name, key_root, clock, bounds)
        return spark.createDataFrame(totals.collect(), totals.schema)


def _run(spark, feed, lookups, names, control_path, tracking_path, load_date, job_name, key_root, clock, bounds) -> DataFrame:
    started = clock()
    runs.create_tables(spark, control_path, tracking_path)
    source_count = target_count = 0
    status = runs.FAILED
    try:
        journal.finish_open(spark, f"{control_path}.journal")
        mark = manifests.watermark(runs.read_control(spark, control_path), job_name)
        discovered = materialize(manifests.discover(spark, feed, mark, key_root=key_root, bounds=bounds), "manifests")
        tracked = runs.read_tracking(spark, tracking_path).where(F.col("job_name") == job_name)
        found, records, unreadable = _land(spark, discovered, feed, tracked)
        quality.enforce(found, quality.row_count_gt(0))
        source_count = records.count()

        outputs = _outputs(records, lookups, load_date, started)
        changes = []
        for target, rows in outputs.items():
            _, mode, key = TARGETS[target]
            destination = Destination(names[target], mode, key, group_by=activations.MERGE_KEYS)
            changes.append(prepare_load(rows, destination, staged=True))
            target_count += rows.count()
        read = found.where(F.col("bytes").isNotNull() & ~F.col("folder").isin(unreadable))
        tracking = runs.file_tracking(records, job_name, started, read)
        changes.append(tables.prepare_files(tracking, tracking_path))
        journal.load_all(spark, f"{control_path}.journal", changes)

        outcomes = runs.folder_outcomes(found, records, unreadable)
        per_folder = materialize(_per_folder(outcomes, records, found, lookups), "folders")
        status = per_folder.agg(runs.run_status(per_folder)).first()[0]
        return runs.run_summary(per_folder, target_count)
    finally:
        ended = clock()
        record = runs.control_record(
            spark,
            job_name,
            source_count,
            target_count,
            status,
            started,
            ended,
            load_date,
            source_data=feed,
            target_table=",".join(names.values()),
        )
        runs.append_record(record, control_path)


def _land(
    spark: SparkSession, discovered: DataFrame, feed: str, tracked: DataFrame
) -> tuple[DataFrame, DataFrame, list[str]]:
    """The new files, their records, flat and landed once, and the folders that can't be read whole."""
    lists, landing = shared_folder(spark, "files"), shared_folder(spark, "landing")
    folders = discovered.select("folder").distinct().count()
    groups = max(1, -(-folders // GROUP_FOLDERS))
    unreadable: list[str] = []
    for group in range(groups):
        part = discovered.where(F.pmod(F.xxhash64("folder"), F.lit(groups)) == group)
        listed = runs.untracked(manifests.present_and_missing(part, feed), tracked)
        listed.write.parquet(f"{lists}/part={group}")
        listed = spark.read.schema(listed.schema).parquet(f"{lists}/part={group}")
        unreadable += files.land_folders(
            spark, listed, image_schema(), f"{landing}/group={group}", activations.parse_records
        )
    found = spark.read.schema(listed.schema).option("recursiveFileLookup", True).parquet(lists)
    return found, files.landed(spark, image_schema(), landing, activations.parse_records), unreadable


def _outputs(
    records: DataFrame, lookups: Mapping[str, DataFrame], load_date: date, modified: datetime
) -> dict[str, DataFrame]:
    """The rows of each target, each written once before it is loaded.

    Counts go through the lookups already reduced; only project entries go row by row.
    """
    entries = activations.font_entries(records)
    counted = materialize(
        activations.enrich_entries(activations.count_entries(entries), lookups), "counted"
    )
    in_projects = entries.where(F.col("route") == activations.PROJECT_ROUTE)
    projects = materialize(
        activations.project_rows(activations.enrich_entries(in_projects, lookups)), "projects"
    )
    usage = activations.monthly_usage(activations.enrich_usage(counted, lookups), "entries")
    rows = {
        "sync_download": activations.sync_download(counted, load_date, "entries"),
        "asset": activations.assets(projects),
        "project": activations.project_summary(projects),
        "usage_data": usage.withColumn("last_modified", F.lit(modified)),
    }
    return materialize_all(rows)


def _per_folder(
    outcomes: DataFrame,
    records: DataFrame,
    found: DataFrame,
    lookups: Mapping[str, DataFrame],
) -> DataFrame:
    """Status and record counters per folder. Records are counted by user and reason before
    the customer lookup tells which of them were skipped for lack of a customer."""
    folders = found.select(runs.file_name("data_file").alias("__name"), "folder")
    counted = (
        records.groupBy("source_file", "mtf_id", "reject_reason")
        .agg(F.count(F.lit(1)).alias("records"))
        .withColumn("__name", runs.file_name("source_file"))
        .join(folders, "__name")
    )
    resolved = enrich.enrich(
        counted,
        lookups["customers"],
        {"mtf_id": "identity_provider_id"},
        {"gcid": "customer_id"},
    )
    marked = quality.mark_rejects(
        resolved, [(activations.NO_CUSTOMER, F.col("gcid").isNotNull())]
    )
    counters = runs.counters(marked, activations.RECORD_REASONS, ["folder"], weight="records")
    totals = [c for c in counters.columns if c != "folder"]
    joined = outcomes.select("folder", "status").join(counters, "folder", "left")
    return joined.fillna(0, totals)
