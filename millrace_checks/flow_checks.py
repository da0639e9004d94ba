"""Sources, quality reports, sinks, run control and streams. Files go to the shared folder."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace_checks.column_checks import ANALYTICS_ORACLE
from millrace_checks.event_checks import (
    DAILY_SALES,
    LOAD_DATE,
    NEW_USAGE_CTE,
    REASON,
    ROLLED,
    SESSION_CTE,
    SESSION_METRICS,
    new_usage,
)
from millrace_checks.fixtures import (
    LOOKUP_VIEWS,
    USAGE_VIEWS,
    frame,
    images,
    lookups,
    table,
    with_views,
)
from millrace_checks.registry import check
from millrace.control import runs
from millrace.functions.images import image_schema
from millrace.operators import columns, quality, windows
from millrace.plans import activation_job, activations, activity, daily, orders
from millrace.functions.text import uuid_text
from millrace.plans.runner import Destination, build_checks, load, read_rejects, run_pipeline, run_spec
from millrace.session import materialize, shared_folder
from millrace.sinks import tables
from millrace.sources import files, manifests, streams
from millrace.sources.extract import open_source
from millrace.streaming import sinks as stream_sinks

UTC = datetime.timezone.utc


def _new_table(spark, schema, partition_by=(), buckets=None):
    name = f"check_{uuid.uuid4().hex}"
    tables.create_table(spark, name, schema, shared_folder(spark, "table"), partition_by, buckets)
    return name


# Sources


@check(
    "scan_full",
    """SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
    l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, epoch_us(l_shipdate) AS l_shipdate FROM lineitem""",
)
def scan_full(spark, sf):
    """A table of the catalog through the reader that pipelines use."""
    name = f"lineitem_{uuid.uuid4().hex}"
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{sf}/lineitem.parquet'")
    return open_source(spark, {"source": "table", "table": name})


@check(
    "scan_row_limit",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders ORDER BY o_orderkey LIMIT 3000""",
)
def scan_row_limit(spark, sf):
    df = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return windows.row_limit(df, 3000, ["o_orderkey"])


@check(
    "scan_query_date",
    """SELECT o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' GROUP BY o_orderpriority""",
)
def scan_query_date(spark, sf):
    query = """SELECT o_orderpriority, count(*) AS orders,
      CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total
    FROM {orders} WHERE o_orderdate >= CAST(:execution_date AS TIMESTAMP) GROUP BY o_orderpriority"""
    return files.run_query(spark, query, "1997-01-01", orders=table(spark, sf, "orders"))


@check(
    "scan_csv",
    with_views(
        "sales",
        """SELECT order_id, customer_id, product_id, quantity, unit_price, region,
        CAST(order_date AS VARCHAR) AS order_date, payment_method FROM sales""",
    ),
)
def scan_csv(spark, sf):
    path = shared_folder(spark, "csv")
    names = daily.SALES_SCHEMA.fieldNames()
    frame(spark, sf, "sales").select(*names).write.option("header", True).csv(path)
    return files.read_csv(spark, path, daily.SALES_SCHEMA, names)


@check(
    "scan_jsonl_nested",
    with_views(
        "activation_flat",
        """SELECT CASE WHEN event_id % 53 <> 0 THEN CAST(event_id AS VARCHAR) END AS event_id,
        CASE WHEN event_id % 53 <> 0 THEN event_name END AS event_type,
        CASE WHEN event_id % 53 <> 0 THEN user_email END AS user_email,
        CASE WHEN event_id % 53 <> 0 THEN CAST(fonts_n AS BIGINT) ELSE 0 END AS fonts,
        event_id % 53 = 0 AS corrupt FROM activation_flat""",
    ),
)
def scan_jsonl_nested(spark, sf):
    """One line in 53 is cut off; it is kept as a corrupt row, the others parse."""
    path = shared_folder(spark, "jsonl")
    line = F.to_json(F.struct("eventID", "dynamodb"))
    broken = F.col("eventID").cast("bigint") % 53 == 0
    images(spark, sf).select(
        F.when(broken, F.substring(line, 1, 30)).otherwise(line).alias("value")
    ).write.option("compression", "gzip").text(path)
    raw = files.read_json_lines(spark, path, image_schema())
    parsed = columns.parse_image(raw)
    return parsed.select(
        "event_id",
        "event_type",
        F.col("user").alias("user_email"),
        F.size("fonts").alias("fonts"),
        F.col(files.CORRUPT).isNotNull().alias("corrupt"),
    )


def _write_folders(spark, sf, root, batches, listed, absent=()):
    """Event images as gzipped JSON lines, one folder per batch; a manifest where ``listed``,
    which for ``absent`` batches also names a file that does not exist."""
    batch = F.col("eventID").cast("bigint") % 4
    (
        images(spark, sf)
        .withColumn("batch", batch)
        .where(F.col("batch").isin(list(batches)))
        .write.mode("append")
        .partitionBy("batch")
        .option("compression", "gzip")
        .json(root)
    )
    for b in listed:
        folder = f"{root}/batch={b}"
        names = manifests.stored_files(spark, folder).select(
            F.col("data_file").alias(manifests.DATA_KEY_FIELD)
        )
        if b in absent:
            extra = names.limit(1).select(
                F.concat(F.lit(f"{folder}/gone-"), F.lit("1.json.gz")).alias(manifests.DATA_KEY_FIELD)
            )
            names = names.unionByName(extra)
        names.coalesce(1).write.json(f"{folder}/{manifests.MANIFEST_FILE}")


def _discovered(spark, root, newer_than=None):
    return manifests.present_and_missing(manifests.discover(spark, root, newer_than), root)


def _read_discovered(spark, found):
    return files.read_json_lines(spark, manifests.file_list(found), image_schema())


@check("scan_manifest", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM events WHERE event_id % 4 <> 3")
def scan_manifest(spark, sf):
    """The folder without a manifest is not read."""
    root = shared_folder(spark, "feed")
    _write_folders(spark, sf, root, range(4), listed=[0, 1, 2])
    return columns.parse_image(_read_discovered(spark, _discovered(spark, root))).select("event_id")


@check("scan_incremental", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM events WHERE event_id % 4 IN (2, 3)")
def scan_incremental(spark, sf):
    """Two folders before a successful run, two after it; a later failed run moves nothing."""
    root, control = shared_folder(spark, "feed"), shared_folder(spark, "control")
    _write_folders(spark, sf, root, [0, 1], listed=[0, 1])
    first = columns.parse_image(_read_discovered(spark, _discovered(spark, root)))
    count = first.count()
    now = datetime.datetime.now(UTC)
    later = now + datetime.timedelta(days=1)
    for status, at in ((runs.SUCCESS, now), (runs.FAILED, later)):
        record = runs.control_record(spark, "activations", count, count, status, at, at, at.date())
        runs.append_record(record, control)
    _write_folders(spark, sf, root, [2, 3], listed=[2, 3])
    mark = manifests.watermark(runs.read_control(spark, control), "activations")
    found = _discovered(spark, root, newer_than=mark)
    return columns.parse_image(_read_discovered(spark, found)).select("event_id")


@check("scan_incremental_days", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM events WHERE event_id % 4 IN (2, 3)")
def scan_incremental_days(spark, sf):
    """A feed with day folders: a run lists the days from the mark on. Of three days, the one long
    past is not listed, though a manifest comes to it after the mark."""
    root, mark = shared_folder(spark, "feed"), datetime.datetime.now(UTC)
    days = [mark - datetime.timedelta(days=n) for n in (30, 1, 0)]
    for day, batches in zip(days, ([0, 1], [2], [3])):
        _write_folders(spark, sf, f"{root}/{day:%Y/%m-%d}", batches, listed=batches)
    bounds = manifests.Bounds(days="%Y/%m-%d", lookback_days=2)
    found = manifests.present_and_missing(manifests.discover(spark, root, mark, bounds=bounds), root)
    return columns.parse_image(_read_discovered(spark, found)).select("event_id")


# Ordering


@check(
    "sort_rows",
    with_views(
        "raw_orders",
        """SELECT id, row_number() OVER (ORDER BY created DESC NULLS LAST, order_id ASC NULLS LAST, id) AS position
        FROM (SELECT id, order_id, try_strptime(created_at, '%Y-%m-%d %H:%M:%S') AS created FROM raw_orders)""",
    ),
)
def sort_rows(spark, sf):
    """Writes the sorted table and reads back every row's place: the rows of the files before
    its own, plus its place in the file. No task holds the whole order."""
    df = columns.parse_dates(frame(spark, sf, "raw_orders"), {"created_at": orders.DATE_FORMAT})
    path = shared_folder(spark, "sorted")
    windows.sort_rows(df, ["created_at", "order_id"], [False, True], ["id"]).select("id").write.parquet(path)
    part = F.regexp_extract(F.col("_metadata.file_name"), r"part-(\d+)", 1).cast("bigint")
    chunk = F.regexp_extract(F.col("_metadata.file_name"), r"-c(\d+)", 1).cast("bigint")
    rows = spark.read.parquet(path).select(
        "id", part.alias("part"), chunk.alias("chunk"), F.col("_metadata.row_index").alias("row_index")
    )
    counts = rows.groupBy("part", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = windows.Window.orderBy("part", "chunk").rowsBetween(windows.Window.unboundedPreceding, -1)
    offsets = counts.select(
        "part", "chunk", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")
    )
    return rows.join(offsets, ["part", "chunk"]).select(
        "id", (F.col("before") + F.col("row_index") + 1).alias("position")
    )


# Quality reports


def _qc_line(name, target, violations):
    return f"SELECT '{name}' AS check_name, '{target}' AS target, CAST({violations} AS BIGINT) AS violations FROM t"


@check(
    "qc_report",
    with_views(
        "raw_orders",
        """SELECT *, violations = 0 AS passed FROM ("""
        + " UNION ALL ".join(
            [
                _qc_line("row_count_gt", "*", "CASE WHEN count(*) > 0 THEN 0 ELSE 1 END"),
                _qc_line("required_fields_not_null", "id", "count_if(id IS NULL)"),
                _qc_line("required_fields_not_null", "email", "count_if(email IS NULL)"),
                _qc_line("column_not_null", "created_at", "count_if(created_at IS NULL)"),
                _qc_line("unique_check", "order_id,email", "count(*) - count(DISTINCT (order_id, email))"),
                _qc_line("value_range", "attempts", "count_if(NOT coalesce(attempts BETWEEN 0 AND 4, false))"),
                _qc_line(
                    "allowed_values",
                    "status",
                    "count_if(NOT coalesce(status IN ('success', 'pending'), false))",
                ),
            ]
        )
        + ")",
        "t AS (SELECT *, CAST(attempt_count AS BIGINT) AS attempts FROM raw_orders)",
    ),
)
def qc_report(spark, sf):
    df = frame(spark, sf, "raw_orders").withColumn("attempts", F.col("attempt_count").cast("bigint"))
    checks = build_checks(
        [
            {"row_count_gt": 0},
            {"required_fields_not_null": {"fields": ["id", "email"]}},
            {"column_not_null": ["created_at"]},
            {"unique_check": {"columns": ["order_id", "email"]}},
            {"value_range": {"column": "attempts", "min": 0, "max": 4}},
            {"allowed_values": {"column": "status", "values": ["success", "pending"]}},
        ]
    )
    return quality.report(df, checks)


@check(
    "qc_unique",
    """SELECT 'unique_check' AS check_name, 'l_orderkey,l_linenumber' AS target,
    count(*) - count(DISTINCT (l_orderkey, l_linenumber)) AS violations,
    count(*) = count(DISTINCT (l_orderkey, l_linenumber)) AS passed FROM lineitem""",
)
def qc_unique(spark, sf):
    return quality.report(table(spark, sf, "lineitem"), quality.unique(["l_orderkey", "l_linenumber"]))


JOBS = """SELECT o_orderpriority AS job_name, count(*) AS source_count,
  sum(CASE WHEN o_orderstatus = 'F' AND o_orderpriority <> '5-LOW' THEN 1 ELSE 0 END) AS target_count,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Failed' WHEN min(o_orderkey) % 2 = 0 THEN 'Partial'
    ELSE 'Success' END AS load_status
  FROM {0} GROUP BY o_orderpriority"""


@check(
    "qc_unique_wide",
    """SELECT 'unique_check' AS check_name, 'source,text' AS target,
    count(*) - count(DISTINCT (source, text)) AS violations, count(*) = count(DISTINCT (source, text)) AS passed FROM documents""",
)
def qc_unique_wide(spark, sf):
    """Whole texts as a key: only those whose hash repeats are exchanged."""
    documents = spark.read.schema("source STRING, text STRING").parquet(f"{sf}/documents.parquet")
    return quality.report(documents, quality.unique(["source", "text"], wide=True))


def _jobs(spark, sf):
    return spark.sql(JOBS.format("{orders}"), orders=table(spark, sf, "orders"))


@check(
    "qc_post_status",
    f"SELECT job_name, load_status, load_status IN ('Success', 'Partial') AS passed FROM ({JOBS.format('orders')})",
)
def qc_post_status(spark, sf):
    return runs.status_check(_jobs(spark, sf))


@check(
    "qc_post_counts",
    f"""SELECT job_name, source_count, CAST(target_count AS BIGINT) AS target_count,
    source_count = 0 OR target_count > 0 AS passed FROM ({JOBS.format('orders')})""",
)
def qc_post_counts(spark, sf):
    return runs.count_check(_jobs(spark, sf))


# Sinks

ORDER_COLUMNS = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"
ORDER_SELECT = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders"


@check("sink_append", ORDER_SELECT)
def sink_append(spark, sf):
    target = _new_table(spark, ORDER_COLUMNS)
    df = table(spark, sf, "orders")
    tables.append(df.where("o_orderstatus = 'F'"), target)
    tables.append(df.where("NOT (o_orderstatus <=> 'F')"), target)
    return spark.table(target)


@check("sink_replace", ORDER_SELECT)
def sink_replace(spark, sf):
    """The second load reads the table it replaces."""
    target = _new_table(spark, ORDER_COLUMNS)
    df = table(spark, sf, "orders")
    tables.replace(df.where("o_orderstatus = 'F'"), target)
    rest = df.where("NOT (o_orderstatus <=> 'F')").select(*spark.table(target).columns)
    tables.replace(spark.table(target).unionByName(rest), target)
    return spark.table(target)


SALES_TABLE = "region STRING, order_date DATE, total_revenue DOUBLE, order_count BIGINT, avg_order_value DOUBLE"
SALES_VIEWS = "sales"


def _daily(flag):
    return DAILY_SALES.replace("FROM first_sales", f"FROM sales WHERE {flag}").replace("count(order_id)", "count(*)")


UPSERT_ORACLE = with_views(
    SALES_VIEWS,
    """SELECT * FROM fresh UNION ALL BY NAME SELECT * FROM old
    WHERE (region, order_date) NOT IN (SELECT (region, order_date) FROM fresh)""",
    f"""old AS ({_daily("payment_method <> 'R'")}), fresh AS ({_daily("payment_method = 'R'")})""",
)


def _upsert(spark, sf, partition_by, buckets=None):
    target = _new_table(spark, SALES_TABLE, partition_by, buckets)
    sales = frame(spark, sf, "sales").withColumn("revenue", F.expr("quantity * unit_price"))

    def daily_of(condition):
        metrics = {**daily.SALES_METRICS, "order_count": "count(*)"}
        return daily.apply_steps(
            sales.where(condition), [{"aggregate_daily": {"group_by": ["region", "order_date"], "metrics": metrics}}]
        )

    tables.append(daily_of("payment_method <> 'R'"), target)
    fresh = daily_of("payment_method = 'R'")
    for _ in range(2):
        tables.upsert(fresh, target, daily.SALES_UPSERT_KEY)
    return spark.table(target)


@check("sink_upsert", UPSERT_ORACLE)
def sink_upsert(spark, sf):
    """Applied twice: the second time changes nothing."""
    return _upsert(spark, sf, ())


@check("sink_upsert_partitioned", UPSERT_ORACLE)
def sink_upsert_partitioned(spark, sf):
    """Only the touched partitions are rewritten."""
    return _upsert(spark, sf, ("region",))


@check("sink_upsert_bucketed", UPSERT_ORACLE)
def sink_upsert_bucketed(spark, sf):
    """No column of the key partitions the table: only the touched key buckets are rewritten."""
    return _upsert(spark, sf, (), tables.KeyBuckets(tuple(daily.SALES_UPSERT_KEY), 16)).drop(tables.BUCKET)


@check(
    "sink_insert_ignore",
    """SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus <> 'F', o_orderkey) AS rn FROM orders)
    WHERE rn = 1""",
)
def sink_insert_ignore(spark, sf):
    """Finished orders first, then all orders, twice: one row per customer, never replaced."""
    target = _new_table(spark, ORDER_COLUMNS)
    df = table(spark, sf, "orders")
    for part in (df.where("o_orderstatus = 'F'"), df, df):
        tables.insert_ignore(part, target, ["o_custkey"], order_by=["o_orderkey"])
    return spark.table(target)


@check(
    "sink_monthly_merge",
    with_views(
        f"{USAGE_VIEWS} usage_existing",
        ROLLED.format("SELECT * FROM usage_existing UNION ALL BY NAME SELECT * FROM new_usage"),
        NEW_USAGE_CTE,
    ),
)
def sink_monthly_merge(spark, sf):
    existing = frame(spark, sf, "usage_existing")
    parts = ["year", "month"]
    schema = T.StructType(
        [f for f in existing.schema if f.name not in parts] + [existing.schema[p] for p in parts]
    )
    target = _new_table(spark, schema, parts)
    tables.append(existing, target)
    tables.monthly_merge(new_usage(spark, sf), target, activations.MERGE_KEYS)
    return spark.table(target)


@check(
    "sink_project_columns",
    "SELECT o_orderkey AS id, o_orderpriority AS name, o_totalprice * 2 AS amount FROM orders",
)
def sink_project_columns(spark, sf):
    target = _new_table(spark, "id BIGINT, name STRING, amount DOUBLE")
    projection = {"id": "o_orderkey", "name": "o_orderpriority", "amount": "o_totalprice * 2"}
    load(table(spark, sf, "orders"), Destination(target, "append", columns=projection))
    return spark.table(target)


@check(
    "sink_typed",
    f"""SELECT * REPLACE (CAST(CAST(processing_lag_days AS DECIMAL(10,2)) AS DOUBLE) AS processing_lag_days,
    CAST(processed_date AS BIGINT) AS processed_date) FROM ({ANALYTICS_ORACLE})""",
    doubles=('order_created_at', 'processed_date'),
)
def sink_typed(spark, sf):
    target = _new_table(spark, orders.ANALYTICS_TABLE)
    tables.replace(orders.order_analytics(frame(spark, sf, "raw_orders")), target)
    return spark.table(target)


@check(
    "fanout_counts",
    with_views(
        f"{USAGE_VIEWS}",
        """SELECT 'sync_download' AS destination, count(*) AS row_count FROM (
          SELECT DISTINCT gcid, profile_id, font_style_id, family_id, event_type, event_date FROM enriched
          WHERE reject_reason IS NULL AND route = 'sync_download_path')
        UNION ALL SELECT 'asset', count(*) FROM (SELECT DISTINCT project_id, font_style_id, ts FROM enriched
          WHERE reject_reason IS NULL AND route = 'webproject_path')
        UNION ALL SELECT 'project', count(DISTINCT project_id) FROM enriched
          WHERE reject_reason IS NULL AND route = 'webproject_path'
        UNION ALL SELECT 'usage_data', count(*) FROM new_usage""",
        NEW_USAGE_CTE,
    ),
)
def fanout_counts(spark, sf):
    """Enriched once, written to four tables, counted in the tables."""
    found = lookups(spark, sf)
    entries = activations.font_entries(activations.parse_records(images(spark, sf)))
    staged = materialize(activations.enrich_entries(entries, found), "enriched")
    projects = activations.project_rows(staged)
    usage = activations.monthly_usage(activations.enrich_usage(staged, found))
    outputs = {
        "sync_download": (activations.sync_download(staged, LOAD_DATE), "append", ()),
        "asset": (activations.assets(projects), "insert_ignore", activations.ASSET_KEYS),
        "project": (activations.project_summary(projects), "insert_ignore", ("id",)),
        "usage_data": (usage, "monthly_merge", ()),
    }
    counts = None
    for name, (df, mode, key) in outputs.items():
        parts = ["year", "month"] if mode == "monthly_merge" else []
        schema = T.StructType([f for f in df.schema if f.name not in parts] + [df.schema[p] for p in parts])
        target = _new_table(spark, schema, parts)
        load(df, Destination(target, mode, key, group_by=activations.MERGE_KEYS))
        one = spark.table(target).agg(F.count(F.lit(1)).alias("row_count"))
        one = one.select(F.lit(name).alias("destination"), "row_count")
        counts = one if counts is None else counts.unionByName(one)
    return counts


# Run control


@check(
    "control_record",
    with_views(
        "weather",
        """SELECT 'weather' AS job_name, CAST(NULL AS VARCHAR) AS source_data, CAST(NULL AS VARCHAR) AS source_database,
        'weather_daily' AS source_table, CAST(NULL AS VARCHAR) AS target_layer, CAST(NULL AS VARCHAR) AS target_database,
        'daily_weather' AS target_table, count(*) AS source_count,
        CAST(count_if(city IS NOT NULL AND temp_f IS NOT NULL) AS BIGINT) AS target_count, '2024-02-01' AS load_date,
        'Success' AS load_status, epoch_us(TIMESTAMP '2024-02-01 00:00:00') AS load_start_time,
        epoch_us(TIMESTAMP '2024-02-01 00:01:00') AS load_end_time, 60.0::DOUBLE AS job_run_time,
        epoch_us(TIMESTAMP '2024-02-01 00:01:00') AS created_on FROM weather""",
    ),
)
def control_record(spark, sf):
    """A whole run: transform, stage, check, load, record. The clock is given."""
    target = _new_table(spark, "date DATE, city STRING, temp_c DOUBLE, humidity INT, wind_speed INT")
    control = shared_folder(spark, "control")
    start = datetime.datetime(2024, 2, 1, tzinfo=UTC)
    ticks = iter([start, start + datetime.timedelta(minutes=1)])
    run_pipeline(
        "weather",
        frame(spark, sf, "weather"),
        daily.WEATHER_STEPS,
        daily.WEATHER_CHECKS,
        [Destination(target, "replace")],
        control,
        clock=lambda: next(ticks),
        source_table="weather_daily",
        target_table="daily_weather",
    )
    return runs.read_control(spark, control)


@check(
    "file_tracking",
    "SELECT 'activations' AS job_name, concat('batch=', CAST(event_id % 4 AS VARCHAR)) AS folder, count(*) AS raw_count FROM events GROUP BY ALL",
)
def file_tracking(spark, sf):
    """One row per file, appended to the tracking table; shown per folder, as file names vary."""
    root, tracking = shared_folder(spark, "feed"), shared_folder(spark, "tracking")
    _write_folders(spark, sf, root, range(4), listed=range(4))
    raw = _read_discovered(spark, _discovered(spark, root))
    rows = runs.file_tracking(raw, "activations", datetime.datetime(2024, 2, 1, tzinfo=UTC))
    rows.write.mode("append").parquet(tracking)
    folder = F.regexp_extract("s3_file_path", r"(batch=\d+)/", 1)
    return (
        spark.read.parquet(tracking)
        .groupBy("job_name", folder.alias("folder"))
        .agg(F.sum("raw_count").alias("raw_count"))
    )


FOLDER_ORACLE = """SELECT concat('batch=', CAST(event_id % 4 AS VARCHAR)) AS folder, count(*) AS raw_count,
  CAST(0 AS BIGINT) AS corrupt_count, CASE WHEN event_id % 4 = 3 THEN 'Failed' ELSE 'Success' END AS status FROM events GROUP BY ALL"""


def _folder_outcomes(spark, sf, root):
    _write_folders(spark, sf, root, range(4), listed=range(4), absent=[3])
    found = _discovered(spark, root)
    raw = files.land(_read_discovered(spark, found))
    return raw, runs.folder_outcomes(found, raw)


@check("folder_status", FOLDER_ORACLE)
def folder_status(spark, sf):
    """A manifest names a file that is gone: its folder fails, the others go on."""
    _, outcomes = _folder_outcomes(spark, sf, shared_folder(spark, "feed"))
    return outcomes.select("folder", "raw_count", "corrupt_count", "status")


@check(
    "run_summary",
    with_views(
        "activation_flat",
        f"""SELECT CAST(4 AS BIGINT) AS folders_processed, CAST(1 AS BIGINT) AS failed_folders, count(*) AS total_raw_count,
        CAST(count_if(r IS NULL OR r NOT IN ('required_fields', 'event_type')) AS BIGINT) AS total_eligible,
        CAST(count_if(r IS NULL) AS BIGINT) AS total_processed, CAST(count_if(r IS NOT NULL) AS BIGINT) AS total_skipped,
        CAST(count_if(r IS NULL) AS BIGINT) AS total_target_count FROM (SELECT {REASON} AS r FROM activation_flat)""",
    ),
)
def run_summary(spark, sf):
    raw, outcomes = _folder_outcomes(spark, sf, shared_folder(spark, "feed"))
    marked = activations.parse_records(raw)
    folder = F.regexp_extract("source_file", r"(batch=\d+)/", 1)
    early = [activations.MISSING_FIELD, activations.WRONG_TYPE]
    counted = runs.counters(marked.withColumn("folder", folder), early, ["folder"])
    per_folder = outcomes.select("folder", "status").join(counted, "folder")
    loaded = shared_folder(spark, "loaded")
    quality.valid_rows(marked).select("event_id").write.parquet(loaded)
    return runs.run_summary(per_folder, spark.read.parquet(loaded).count())


@check(
    "event_ingestion_run",
    with_views(
        USAGE_VIEWS,
        """SELECT customer_id, font_id, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, usage_type,
        source_system, CAST(first_usage AS VARCHAR) AS first_usage, CAST(last_usage AS VARCHAR) AS last_usage,
        usage_count, customer_identifier_type FROM new_usage""",
        NEW_USAGE_CTE,
    ),
)
def event_ingestion_run(spark, sf):
    """Two whole runs over a growing feed. The first is Partial, as a listed file is absent;
    the second finds the old folders again and loads only what is new. The usage table then
    equals one count over all events."""
    feed, control, tracking, root = (
        shared_folder(spark, p) for p in ("feed", "control", "tracking", "targets")
    )
    names = {t: f"check_{uuid.uuid4().hex}" for t in activation_job.TARGETS}
    activation_job.create_targets(spark, names, root)
    for batches, absent in (([0, 1, 2], [2]), ([3], [])):
        _write_folders(spark, sf, feed, batches, listed=batches, absent=absent)
        activation_job.ingest(spark, feed, lookups(spark, sf), names, control, tracking, LOAD_DATE)
    return spark.table(names["usage_data"]).drop("last_modified")


# Streams


def _click_lines(spark, sf, path):
    clicks = frame(spark, sf, "clickstream").select(
        "event_id", "user_id", "event_type", "page_url", F.col("ts").alias("timestamp"), "device_type"
    )
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    clicks.select(F.to_json(F.struct("*"), micros).alias("value")).write.mode("append").text(path)


@check(
    "stream_json_parse",
    with_views(
        "clickstream",
        """SELECT event_id, user_id, event_type, page_url, epoch_us(ts) AS timestamp, device_type,
        CAST(NULL AS VARCHAR) AS referrer FROM clickstream""",
    ),
)
def stream_json_parse(spark, sf):
    source, out, state = (shared_folder(spark, p) for p in ("lines", "parsed", "state"))
    _click_lines(spark, sf, source)
    parsed = streams.parse_json(streams.text_stream(spark, source), activity.CLICK_SCHEMA)
    stream_sinks.finish(stream_sinks.append_files(parsed, out, state))
    return stream_sinks.appended(spark.read.parquet(out))


STREAM_ORACLE = with_views(
    "clickstream users",
    f"""SELECT s.*, account_type, CAST(signup_date AS VARCHAR) AS signup_date, country FROM (
    SELECT user_id, epoch_us(min(ts)) AS session_start, {SESSION_METRICS} FROM sessions GROUP BY user_id, session_id) s
    LEFT JOIN users USING (user_id)""",
    SESSION_CTE,
)


@check("stream_sessions", STREAM_ORACLE)
def stream_sessions(spark, sf):
    """Complete mode over the events as a stream: equals the batch result."""
    out, state = shared_folder(spark, "sessions"), shared_folder(spark, "state")
    events = table(spark, sf, "events")
    # A glob, so that the table may be one file or a folder.
    stream = spark.readStream.schema(events.schema).parquet(f"{sf}/events.parque[t]")
    metrics = activity.user_session_stream(_clicks_of(spark, stream), frame(spark, sf, "users"))
    stream_sinks.finish(stream_sinks.replace_files(metrics, out, state))
    return stream_sinks.latest(spark.read.parquet(out))


@check("stream_sessions_append", STREAM_ORACLE)
def stream_sessions_append(spark, sf):
    """Append mode; a later event far ahead moves the watermark and closes every session."""
    source, out, state = (shared_folder(spark, p) for p in ("events", "sessions", "state"))
    events = table(spark, sf, "events")
    users = frame(spark, sf, "users")
    ahead = events.limit(1).withColumns(
        {"user_id": F.lit(-1).cast("bigint"), "ts": F.lit(datetime.datetime(2100, 1, 1, tzinfo=UTC))}
    )
    for part in (events, ahead):
        part.write.mode("append").parquet(source)
        stream = spark.readStream.schema(events.schema).parquet(source)
        metrics = activity.user_session_stream(_clicks_of(spark, stream), users)
        stream_sinks.finish(stream_sinks.append_files(metrics, out, state))
    return stream_sinks.appended(spark.read.parquet(out))


def _clicks_of(spark, events):
    from millrace_checks.fixtures import VIEWS

    return spark.sql(VIEWS["clickstream"], events=events).withColumnRenamed("ts", "timestamp")


def event_spec(source: str, targets: dict[str, str]) -> dict:
    """The event ingestion as one declared pipeline with four outputs."""
    web = f"route = '{activations.PROJECT_ROUTE}'"
    constants = {"source_system": activations.SOURCE_SYSTEM, "customer_identifier_type": activations.IDENTIFIER_TYPE}
    steps = [
        {"parse_dynamodb": {"record_path": "$.dynamodb.NewImage"}},
        {"parse_font_identifier": {"delimiter": ":XTS:", "output_fields": {"ps_name": "index 0", "fontsense_id": "index 5"}}},
        {"filter_event_types": {"allowed": list(activations.EVENT_TYPES)}},
        {"split_routing": {
            "condition": activations.PROJECT_CONDITION,
            "when_true": {"route": activations.PROJECT_ROUTE}, "when_false": {"route": activations.DOWNLOAD_ROUTE}}},
        {"enrich_gcid": {
            "source_field": "mtf_id", "lookup": "customers", "keys": ["identity_provider_id"], "returns": ["customer_id"],
            "target_field": "gcid", "on_miss": "skip_record"}},
        {"enrich_style": {
            "source_field": "fonts[].fontsense_id", "lookup": "styles", "either_key": ["font_style_id", "pimid"],
            "returns": ["font_style_id", "family_id"], "target_fields": ["font_style_id", "family_id"],
            "on_miss": "skip_font_entry"}},
        {"enrich_profile": {
            "source_fields": ["user", "gcid"], "lookup": "profiles", "keys": ["email", "customer_id"],
            "returns": ["profile_id"], "target_field": "profile_id", "on_miss": "keep"}},
        {"enrich_font_universe": {"source_fields": ["fontsense_id", "ps_name"], "lookup": "fonts", "target_field": "font_id"}},
        {"derive_column": {"target_field": "customer_id", "expression": "gcid"}},
        {"derive_column": {"target_field": "usage_type", "expression": "event_type"}},
        {"derive_column": {"target_field": "created_at", "expression": "timestamp"}},
        {"static_columns": {**constants, "is_deleted": False}},
        {"derive_column": {"target_field": "asset_deleted_at", "expression": "CAST(NULL AS TIMESTAMP)"}},
        {"aggregate_sync_download": {
            "where": f"NOT ({web}) AND profile_id IS NOT NULL", "group_by": list(activations.DOWNLOAD_KEYS),
            "metrics": {"event_count": "len()"}, "static_columns": activations.DOWNLOAD_CONSTANTS}},
        {"aggregate_asset": {
            "where": web, "deduplicate_by": list(activations.ASSET_KEYS), "columns": list(activations.ASSET_COLUMNS)}},
        {"aggregate_project": {
            "where": web, "deduplicate_by": ["project_id"], "agg": {"created_at": "min"},
            "keep_first": list(activations.PROJECT_FIRST)}},
        {"aggregate_font_universe_usage": {
            "metrics": {"fu_event_count": "len()"}, "constants": ["customer_identifier_type"],
            "monthly_merge": {"enabled": True, "group_by": list(activations.MERGE_KEYS)}}},
    ]
    columns_of = {"project": {
        "id": "project_id", "name": "project_name", "project_type": "project_type", "profile_id": "profile_id",
        "gcid": "gcid", "created_at": "created_at", "is_deleted": "is_deleted"}}
    froms = {
        "sync_download": "aggregate_sync_download", "asset": "aggregate_asset", "project": "aggregate_project",
        "usage_data": "aggregate_font_universe_usage",
    }
    return {
        "name": "events",
        "extract": {"source": "table", "table": source},
        "transform": {"steps": steps},
        "quality_checks": {
            "pre_load": [
                {"row_count_gt": -1},
                {"required_fields_not_null": {"fields": ["mtf_id", "user", "timestamp", "event_type"], "on_fail": "skip_record"}},
                {"event_type_in": {"allowed": list(activations.EVENT_TYPES), "on_fail": "skip_record"}},
                {"font_list_not_empty": {"on_fail": "skip_record"}},
                {"lookup_resolved": {"fields": ["gcid", "font_style_id"], "on_fail": "skip_record"}},
                {"font_universe_fields_valid": {"required": ["customer_id", "font_id", "event_date"], "on_fail": "skip_fu_record"}},
            ],
            "post_load": [
                {"control_record_status": {"expected": ["Success", "Partial"]}},
                {"source_vs_target_count": {"comparison": "target_count > 0 when source_count > 0"}},
            ],
        },
        "load": {"destinations": [
            {"table": targets[t], "mode": activation_job.TARGETS[t][1], "key": activation_job.TARGETS[t][2], "from": froms[t],
             "columns": columns_of.get(t), "group_by": activations.MERGE_KEYS}
            for t in activation_job.TARGETS]},
    }


@check(
    "spec_event_ingestion",
    with_views(
        f"{USAGE_VIEWS}",
        """SELECT 'asset' AS target, project_id AS k1, CAST(font_style_id AS VARCHAR) AS k2,
          arg_min(gcid, CAST(event_id AS VARCHAR)) AS k3, CAST(epoch_us(ts) AS VARCHAR) AS k4, 1 AS n
          FROM enriched WHERE reject_reason IS NULL AND route = 'webproject_path' GROUP BY project_id, font_style_id, ts
        UNION ALL SELECT 'project', project_id, concat('Project ', project_id), 'WebProject', CAST(epoch_us(min(ts)) AS VARCHAR), 1
          FROM enriched WHERE reject_reason IS NULL AND route = 'webproject_path' GROUP BY project_id
        UNION ALL SELECT 'sync_download', gcid, profile_id, CAST(font_style_id AS VARCHAR), concat(event_type, ' ', event_date), count(*)
          FROM enriched WHERE reject_reason IS NULL AND route = 'sync_download_path'
          GROUP BY gcid, profile_id, font_style_id, family_id, event_type, event_date
        UNION ALL SELECT 'usage_data', customer_id, CAST(font_id AS VARCHAR), usage_type, concat(year, '-', month, ' ', first_usage, ' ', last_usage), usage_count
          FROM new_usage""",
        NEW_USAGE_CTE,
    ),
)
def spec_event_ingestion(spark, sf):
    """The declared pipeline from a table of event images to four tables, whose content is compared."""
    raw = {name: frame(spark, sf, view) for name, view in LOOKUP_VIEWS.items()}
    raw["profiles"] = raw["profiles"].select("email", "customer_id", uuid_text(F.unhex("profile_hex")).alias("profile_id"))
    source = f"images_{uuid.uuid4().hex}"
    folder = shared_folder(spark, "images")
    images(spark, sf).write.parquet(folder)
    spark.sql(f"CREATE TABLE {source} USING parquet LOCATION '{folder}'")
    targets = {t: f"{t}_{uuid.uuid4().hex}" for t in activation_job.TARGETS}
    activation_job.create_targets(spark, targets, shared_folder(spark, "targets"))
    run_spec(spark, event_spec(source, targets), shared_folder(spark, "control"), lookups=raw, execution_date=LOAD_DATE)

    def keyed(target, *keys, n="CAST(1 AS BIGINT)"):
        named = [F.expr(k).cast("string").alias(f"k{i}") for i, k in enumerate(keys, 1)]
        return spark.table(targets[target]).select(F.lit(target).alias("target"), *named, F.expr(n).alias("n"))

    rows = keyed("asset", "project_id", "font_style_id", "gcid", "unix_micros(created_at)")
    rows = rows.unionByName(keyed("project", "id", "name", "project_type", "unix_micros(created_at)"))
    rows = rows.unionByName(keyed(
        "sync_download", "gcid", "profile_id", "font_style_id", "concat(event_type, ' ', event_date)", n="event_count"))
    return rows.unionByName(keyed(
        "usage_data", "customer_id", "font_id", "usage_type",
        "concat(year, '-', month, ' ', first_usage, ' ', last_usage)", n="usage_count"))


# Declared streams, and counts of runs


def _activity_spec(source, target, folder, late=None):
    """The click pipeline: lines of JSON arriving as files, to closed sessions in a table."""
    late_rows = {"late_rows": {"table": late[0], "path": late[1]}} if late else {}
    return {
        "name": "user_activity",
        "extract": {"source": "json_files", "path": source, "watermark": {"delay_minutes": 10}},
        "transform": {"steps": [
            {"filter_bots": {"condition": "device_type != 'bot'"}},
            {"sessionize": {"partition_by": "user_id", "order_by": "timestamp", "inactivity_gap_minutes": 30, "output_column": "session_id"}},
            {"enrich_user_profile": {"lookup_table": "users", "join_key": "user_id", "fields": ["account_type", "signup_date", "country"]}},
            {"aggregate_sessions": {
                "group_by": ["user_id", "session_id"],
                "metrics": {"page_views": "count(page_url)", "session_duration_sec": "max(timestamp) - min(timestamp)", "unique_pages": "count_distinct(page_url)"},
                "keep_first": ["device_type", "country", "account_type"], "order_by": ["timestamp", "event_id"],
            }},
        ]},
        "quality_checks": {"pre_load": [{"row_count_gt": 0}, {"required_fields_not_null": {"fields": ["user_id", "session_id", "page_views"]}}]},
        "load": {**late_rows, "destinations": [{
            "table": target, "path": folder, "mode": "append",
            "target_ddl": """user_id BIGINT, session_id BIGINT, page_views BIGINT, session_duration_sec DOUBLE, unique_pages BIGINT,
                device_type STRING, country STRING, account_type STRING, load_date DATE""",
        }]},
    }


def _write_lines(clicks, path):
    micros = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
    clicks.select(F.to_json(F.struct("*"), micros).alias("value")).write.mode("append").text(path)


def _far_ahead(clicks):
    """A click that moves the watermark past every session."""
    later = {"user_id": F.lit(-1).cast("bigint"), "timestamp": F.lit(datetime.datetime(2100, 1, 1, tzinfo=UTC)), "device_type": F.lit("web")}
    return clicks.limit(1).withColumns(later)


def _click_frame(spark, sf):
    return frame(spark, sf, "clickstream").select(
        "event_id", "user_id", "event_type", "page_url", F.col("ts").alias("timestamp"), "device_type"
    )


@check(
    "spec_user_activity",
    with_views(
        "clickstream users",
        f"""SELECT s.*, country, account_type, '{LOAD_DATE}' AS load_date FROM (
        SELECT user_id, epoch_us(min(ts)) AS session_id, {SESSION_METRICS} FROM sessions GROUP BY user_id, session_id) s
        LEFT JOIN users USING (user_id)""",
        SESSION_CTE,
    ),
)
def spec_user_activity(spark, sf):
    """The declared stream in two runs, whose sessions go on from one to the other: equals the batch."""
    source, folder = (shared_folder(spark, p) for p in ("lines", "sessions"))
    target, control = f"sessions_{uuid.uuid4().hex}", shared_folder(spark, "control")
    clicks, users = _click_frame(spark, sf), frame(spark, sf, "users")
    half = F.col("timestamp") < F.lit(clicks.agg(F.expr("timestamp_micros((min(unix_micros(timestamp)) + max(unix_micros(timestamp))) div 2)")).first()[0])
    for part in ([clicks.where(half)], [clicks.where(~half), _far_ahead(clicks)]):
        for rows in part:
            _write_lines(rows, source)
            run_spec(spark, _activity_spec(source, target, folder), control, activity.CLICK_SCHEMA, {"users": users}, LOAD_DATE)
    return spark.table(target).where("user_id >= 0")


@check(
    "stream_late_rows",
    with_views(
        "clickstream",
        """SELECT event_id, epoch_us(ts) AS timestamp FROM clickstream
        WHERE event_id % 3 = 0 AND epoch_us(ts) < (SELECT max(epoch_us(ts)) FROM clickstream WHERE event_id % 3 <> 0) - 600000000""",
    ),
)
def stream_late_rows(spark, sf):
    """A third of the clicks arrives after the others: those before the watermark are in the late rows."""
    source, folder, late = (shared_folder(spark, p) for p in ("lines", "sessions", "late"))
    target, rows, control = f"sessions_{uuid.uuid4().hex}", f"late_{uuid.uuid4().hex}", shared_folder(spark, "control")
    clicks, users = _click_frame(spark, sf), frame(spark, sf, "users")
    for part in ("event_id % 3 <> 0", "event_id % 3 = 0"):
        _write_lines(clicks.where(part), source)
        run_spec(spark, _activity_spec(source, target, folder, (rows, late)), control, activity.CLICK_SCHEMA, {"users": users}, LOAD_DATE)
    return spark.table(rows).select("event_id", "timestamp")


@check(
    "run_source_counts",
    """SELECT 'sorted' AS job_name, count(*) AS source_count, count(*) AS target_count FROM orders
    UNION ALL SELECT 'deduplicated', count(*), count(DISTINCT o_custkey) FROM orders
    UNION ALL SELECT 'limited', least(count(*), 3000), least(count(*), 3000) FROM orders
    UNION ALL SELECT 'filtered', count(*), count_if(o_totalprice > 100000) FROM orders
    UNION ALL SELECT 'branches', count(*), count(*) + count(DISTINCT (o_custkey, o_orderstatus)) FROM orders""",
)
def run_source_counts(spark, sf):
    """Control records of runs whose plans read the source more than once, or only a part of it."""
    control = shared_folder(spark, "control")
    orders_ = table(spark, sf, "orders")
    schema = "o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE"
    sort = {"sort_rows": {"by": ["o_totalprice"], "ascending": False}}
    count = {"aggregate_sync_download": {"group_by": ["o_custkey", "o_orderstatus"], "metrics": ["n"]}}
    cases = {
        "sorted": (orders_, [sort]),
        "deduplicated": (orders_, [{"deduplicate": {"subset": ["o_custkey"], "sort_by": ["o_orderkey"]}}, sort]),
        "limited": (windows.row_limit(orders_, 3000, ["o_orderkey"]), [sort]),
        "filtered": (orders_, [{"filter_rows": {"condition": "o_totalprice > 100000"}}, sort]),
        "branches": (orders_, [sort, count]),
    }
    for name, (source, steps) in cases.items():
        targets = [Destination(_new_table(spark, schema))]
        if name == "branches":
            targets.append(Destination(_new_table(spark, "o_custkey BIGINT, n BIGINT"), output="aggregate_sync_download"))
        run_pipeline(name, source, steps, [], targets, control)
    return runs.read_control(spark, control).select("job_name", "source_count", "target_count")


@check(
    "sink_constraints",
    """SELECT o_orderkey AS order_id, o_custkey AS customer_id, coalesce(o_orderstatus, '') AS status, 'web' AS channel, 0 AS attempts
    FROM orders WHERE o_orderkey % 2 = 0""",
)
def sink_constraints(spark, sf):
    """Half of the orders is loaded with defaults; loads that break a rule publish nothing."""
    from pyspark.errors import PySparkException

    target = _new_table(
        spark, "order_id BIGINT NOT NULL, customer_id BIGINT NOT NULL, status VARCHAR(8) NOT NULL, channel STRING DEFAULT 'web', attempts INT DEFAULT 0"
    )
    rows = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("order_id"), F.col("o_custkey").alias("customer_id"), F.coalesce("o_orderstatus", F.lit("")).alias("status")
    )
    even = F.col("order_id") % 2 == 0
    tables.append(rows.where(even), target)
    odd = rows.where(~even)
    for broken in (
        odd.withColumn("customer_id", F.when(F.col("order_id") % 5 != 0, F.col("customer_id"))),
        odd.withColumn("status", F.repeat("status", F.lit(9))), odd.drop("customer_id"), odd.withColumn("extra", F.lit(1)),
    ):
        try:
            tables.append(broken, target)
        except (PySparkException, ValueError):
            continue
        raise AssertionError("a load that breaks a rule was published")
    return spark.table(target)


@check(
    "scan_csv_corrupt",
    """SELECT 'loaded' AS kind, o_orderkey AS order_id FROM orders WHERE o_orderkey % 7 <> 0
    UNION ALL SELECT 'rejected', o_orderkey FROM orders WHERE o_orderkey % 7 = 0""",
)
def scan_csv_corrupt(spark, sf):
    """A declared CSV of which every seventh line has a text where a number belongs."""
    path, control, target = shared_folder(spark, "csv"), shared_folder(spark, "control"), f"csv_{uuid.uuid4().hex}"
    price = F.when(F.col("o_orderkey") % 7 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("string"))
    table(spark, sf, "orders").select("o_orderkey", price.alias("o_totalprice")).write.option("header", True).csv(path)
    schema = T.StructType.fromDDL("o_orderkey BIGINT, o_totalprice DOUBLE")
    spec = {
        "name": "orders_csv", "extract": {"source": "csv", "path": path}, "transform": {"steps": []},
        "load": {"destinations": [{"table": target, "path": shared_folder(spark, "table"), "target_ddl": "o_orderkey BIGINT, o_totalprice DOUBLE"}]},
    }
    run_spec(spark, spec, control, schema)
    loaded = spark.table(target).select(F.lit("loaded").alias("kind"), F.col("o_orderkey").alias("order_id"))
    rejected = read_rejects(spark, control).select(F.lit("rejected").alias("kind"), F.split("record", ",")[0].cast("bigint").alias("order_id"))
    return loaded.unionByName(rejected)
