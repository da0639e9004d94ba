"""Nested events, lookups, aggregates, windows, routing and the event pipelines."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from millrace_checks.fixtures import (
    ENRICH_VIEWS,
    ENRICHED_CTE,
    PROFILE_ID,
    USAGE_CTE,
    USAGE_VIEWS,
    frame,
    images,
    lookups,
    table,
    with_views,
)
from millrace_checks.registry import check
from millrace.functions.images import RECORD_PATH, any_list_filled, list_union
from millrace.operators import aggregates, columns, enrich, quality, routing, windows
from millrace.plans import activations, activity, daily
from millrace.session import materialize
from millrace.sources.lookups import joined_lookup, lookup, snapshot

LOAD_DATE = datetime.date(2024, 2, 1)


# Nested records


@check(
    "parse_nested_event",
    with_views(
        "activation_flat",
        """SELECT CAST(event_id AS VARCHAR) AS event_id, event_name AS event_type, user_email AS "user", mtf_id,
        epoch_us(ts) AS timestamp, project_id FROM activation_flat""",
    ),
)
def parse_nested_event(spark, sf):
    return columns.parse_image(images(spark, sf)).select(
        "event_id", "event_type", "user", "mtf_id", "timestamp", "project_id"
    )


@check(
    "union_font_lists",
    with_views(
        "activation_flat",
        """SELECT CAST(event_id AS VARCHAR) AS event_id, CAST(fonts_n AS BIGINT) AS fonts,
        CASE WHEN fonts_n > 0 THEN concat('PS-', CAST(fontsense_id % 100000 AS VARCHAR), ':XTS:1:XTS:2:XTS:3:XTS:4:XTS:',
          CAST(fontsense_id AS VARCHAR), ':XTS:0') END AS first_font FROM activation_flat""",
    ),
)
def union_font_lists(spark, sf):
    fonts = list_union(RECORD_PATH)
    return images(spark, sf).select(
        F.col("eventID").alias("event_id"),
        F.size(fonts).alias("fonts"),
        F.get(fonts, F.lit(0)).alias("first_font"),
    )


@check(
    "explode_fonts",
    with_views(
        "activation_flat",
        """SELECT CAST(event_id AS VARCHAR) AS event_id, concat('PS-', CAST((fontsense_id + t.j) % 100000 AS VARCHAR),
          ':XTS:1:XTS:2:XTS:3:XTS:4:XTS:', CAST(fontsense_id + t.j AS VARCHAR), ':XTS:', CAST(t.j AS VARCHAR)) AS font_entry
        FROM activation_flat JOIN (VALUES (0), (1)) t(j) ON t.j < fonts_n""",
    ),
)
def explode_fonts(spark, sf):
    parsed = columns.parse_image(images(spark, sf)).select("event_id", "fonts")
    return columns.explode_fonts(parsed)


@check(
    "parse_font_identifier",
    with_views(
        "activation_flat",
        """SELECT CAST(event_id AS VARCHAR) AS event_id, concat('PS-', CAST((fontsense_id + t.j) % 100000 AS VARCHAR)) AS ps_name,
          CAST(fontsense_id + t.j AS VARCHAR) AS fontsense_id, CAST(t.j AS VARCHAR) AS style_id
        FROM activation_flat JOIN (VALUES (0), (1)) t(j) ON t.j < fonts_n""",
    ),
)
def parse_font_identifier(spark, sf):
    exploded = columns.explode_fonts(columns.parse_image(images(spark, sf)).select("event_id", "fonts"))
    return columns.parse_packed(
        exploded, "font_entry", activations.PACKED_DELIMITER, activations.PACKED_FIELDS
    ).drop("font_entry")


# Lookups and enrichment


@check(
    "lookup_dim",
    """SELECT o_custkey, o_orderstatus, o_orderpriority FROM (
      SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderstatus, o_orderpriority) AS rn FROM orders)
    WHERE rn = 1""",
)
def lookup_dim(spark, sf):
    return lookup(table(spark, sf, "orders"), ["o_custkey"], ["o_orderstatus", "o_orderpriority"])


@check(
    "lookup_dim_joined",
    with_views(
        "profiles",
        f"SELECT email, customer_id, {PROFILE_ID} AS profile_id FROM profiles",
    ),
)
def lookup_dim_joined(spark, sf):
    from millrace.functions.text import uuid_text

    key = F.col("c_custkey").cast("string")
    user_map = table(spark, sf, "customer").select(
        F.concat(F.lit("u"), key, F.lit("@mail.example")).alias("email"),
        F.concat(F.lit("GC"), key).alias("customer_id"),
        F.col("c_custkey").alias("profile_key"),
    )
    profiles = (
        table(spark, sf, "customer")
        .where("c_custkey % 7 <> 0")
        .select(
            F.col("c_custkey").alias("id_key"),
            uuid_text(F.unhex(F.lpad(key, 32, "0"))).alias("profile_id"),
        )
    )
    return joined_lookup(
        user_map, profiles, {"profile_key": "id_key"}, ["email", "customer_id"], ["profile_id"]
    )


def _customers(spark, sf):
    return snapshot(lookup(frame(spark, sf, "identity_map"), ["identity_provider_id"], ["customer_id"]))


@check(
    "enrich_skip_miss",
    with_views(
        "activation_flat identity_map",
        """SELECT event_id, customer_id AS gcid FROM activation_flat
        JOIN identity_map ON identity_provider_id = mtf_id""",
    ),
)
def enrich_skip_miss(spark, sf):
    return enrich.enrich(
        frame(spark, sf, "activation_flat"),
        _customers(spark, sf),
        {"mtf_id": "identity_provider_id"},
        {"gcid": "customer_id"},
        on_miss="skip",
    ).select("event_id", "gcid")


@check(
    "enrich_composite_key",
    with_views(
        "activation_flat identity_map profiles",
        f"""SELECT event_id, i.customer_id AS gcid, CASE WHEN p.email IS NOT NULL THEN {PROFILE_ID} END AS profile_id
        FROM activation_flat JOIN identity_map i ON identity_provider_id = mtf_id
        LEFT JOIN profiles p ON p.email = user_email AND p.customer_id = i.customer_id
        WHERE p.email IS NOT NULL OR (event_name = 'addedToLibrary' AND project_type = 'WebProject')""",
    ),
)
def enrich_composite_key(spark, sf):
    with_customer = enrich.enrich(
        frame(spark, sf, "activation_flat"),
        _customers(spark, sf),
        {"mtf_id": "identity_provider_id"},
        {"gcid": "customer_id"},
        on_miss="skip",
    )
    joined = enrich.enrich(
        with_customer,
        lookups(spark, sf)["profiles"],
        {"user_email": "email", "gcid": "customer_id"},
        {"profile_id": "profile_id"},
        found="has_profile",
    )
    project = "event_name = 'addedToLibrary' AND project_type = 'WebProject'"
    return joined.where(F.col("has_profile") | F.expr(project)).select("event_id", "gcid", "profile_id")


@check(
    "enrich_either_key",
    with_views(
        "activation_flat font_style",
        """SELECT event_id, coalesce(s1.font_style_id, s2.font_style_id) AS font_style_id,
        CAST(CASE WHEN s1.font_style_id IS NOT NULL THEN s1.family_id ELSE s2.family_id END AS BIGINT) AS family_id
        FROM activation_flat LEFT JOIN font_style s1 ON s1.font_style_id = fontsense_id
        LEFT JOIN font_style s2 ON s2.pimid = fontsense_id
        WHERE s1.font_style_id IS NOT NULL OR s2.font_style_id IS NOT NULL""",
    ),
)
def enrich_either_key(spark, sf):
    return enrich.enrich_either_key(
        frame(spark, sf, "activation_flat"),
        frame(spark, sf, "font_style"),
        "fontsense_id",
        ["font_style_id", "pimid"],
        {"font_style_id": "font_style_id", "family_id": "family_id"},
    ).select("event_id", "font_style_id", "family_id")


@check(
    "enrich_fallback_key",
    with_views(
        "activation_flat font",
        """SELECT event_id, coalesce(f1.font_id, f2.font_id) AS font_id
        FROM activation_flat a LEFT JOIN font f1 ON f1.fontsense_id = a.fontsense_id
        LEFT JOIN font f2 ON f2.ps_name = concat('PS-', CAST(a.fontsense_id % 100000 AS VARCHAR))
        WHERE coalesce(f1.font_id, f2.font_id) IS NOT NULL""",
    ),
)
def enrich_fallback_key(spark, sf):
    named = frame(spark, sf, "activation_flat").withColumn(
        "ps_name", F.expr("concat('PS-', fontsense_id % 100000)")
    )
    fonts = frame(spark, sf, "font")
    return enrich.enrich_fallback_key(
        named,
        [
            ("fontsense_id", snapshot(lookup(fonts, ["fontsense_id"], ["font_id"])), "fontsense_id"),
            ("ps_name", snapshot(lookup(fonts, ["ps_name"], ["font_id"])), "ps_name"),
        ],
        {"font_id": "font_id"},
        on_miss="skip",
    ).select("event_id", "font_id")


@check(
    "enrich_type_ids",
    with_views(
        "activation_flat usage_types source_systems identifier_types",
        """SELECT event_id, u.id AS usage_type_id, CAST(s.id AS BIGINT) AS source_system_id,
        CAST(i.id AS BIGINT) AS customer_identifier_type_id
        FROM activation_flat JOIN usage_types u ON u.name = event_name
        JOIN source_systems s ON s.name = 'Connect' JOIN identifier_types i ON i.name = 'GCID'""",
    ),
)
def enrich_type_ids(spark, sf):
    df = frame(spark, sf, "activation_flat").select(
        "event_id",
        F.col("event_name").alias("event_type"),
    )
    return activations.enrich_type_ids(df, lookups(spark, sf)).select(
        "event_id", "usage_type_id", "source_system_id", "customer_identifier_type_id"
    )


@check(
    "enrich_keep_miss",
    with_views(
        "clickstream users",
        """SELECT event_id, account_type, CAST(signup_date AS VARCHAR) AS signup_date, country
        FROM clickstream LEFT JOIN users USING (user_id)""",
    ),
)
def enrich_keep_miss(spark, sf):
    users = lookup(frame(spark, sf, "users"), ["user_id"], list(activity.PROFILE_FIELDS))
    return enrich.enrich(
        frame(spark, sf, "clickstream"),
        users,
        {"user_id": "user_id"},
        {f: f for f in activity.PROFILE_FIELDS},
    ).select("event_id", *activity.PROFILE_FIELDS)


@check(
    "enrich_rejects",
    with_views(
        ENRICH_VIEWS,
        """SELECT CAST(event_id AS VARCHAR) AS event_id, fontsense_id, reject_reason FROM enriched
        WHERE reject_reason IS NOT NULL""",
        ENRICHED_CTE,
    ),
)
def enrich_rejects(spark, sf):
    return quality.rejected_rows(_enriched(spark, sf)).select("event_id", "fontsense_id", "reject_reason")


def _entries(spark, sf):
    return activations.font_entries(activations.parse_records(images(spark, sf)))


def _enriched(spark, sf):
    return activations.enrich_entries(_entries(spark, sf), lookups(spark, sf))


# Routing


@check(
    "split_routing",
    with_views(
        "activation_flat",
        """SELECT event_id, CASE WHEN event_name = 'addedToLibrary' AND project_type = 'WebProject' AND project_id IS NOT NULL
        THEN 'webproject_path' ELSE 'sync_download_path' END AS route FROM activation_flat""",
    ),
)
def split_routing(spark, sf):
    df = frame(spark, sf, "activation_flat").withColumnRenamed("event_name", "event_type")
    return routing.split_routing(
        df, activations.PROJECT_CONDITION, activations.PROJECT_ROUTE, activations.DOWNLOAD_ROUTE
    ).select("event_id", "route")


# Aggregates

DOWNLOAD_ORACLE = with_views(
    ENRICH_VIEWS,
    """SELECT gcid, profile_id, font_style_id, CAST(family_id AS BIGINT) AS family_id, event_type,
    CAST(event_date AS VARCHAR) AS event_date, count(*) AS event_count, 'NA' AS source, 'NA' AS subtype,
    '2024-02-01' AS load_date FROM enriched
    WHERE reject_reason IS NULL AND route = 'sync_download_path'
    GROUP BY gcid, profile_id, font_style_id, family_id, event_type, event_date""",
    ENRICHED_CTE,
)


@check("agg_sync_download", DOWNLOAD_ORACLE)
def agg_sync_download(spark, sf):
    return activations.sync_download(_enriched(spark, sf), LOAD_DATE)


@check("event_ingestion_sync", DOWNLOAD_ORACLE)
def event_ingestion_sync(spark, sf):
    """Counted before the lookups: the joins see one row per user, font, type and day."""
    counted = activations.count_entries(_entries(spark, sf))
    enriched = activations.enrich_entries(counted, lookups(spark, sf))
    return activations.sync_download(enriched, LOAD_DATE, weight="entries")


@check(
    "agg_asset",
    with_views(
        ENRICH_VIEWS,
        """SELECT 'font' AS asset_type, project_id, profile_id, gcid, font_style_id,
        CAST(family_id AS BIGINT) AS family_id, epoch_us(ts) AS created_at, false AS is_deleted,
        CAST(NULL AS BIGINT) AS asset_deleted_at
        FROM (SELECT *, row_number() OVER (PARTITION BY project_id, font_style_id, ts
              ORDER BY CAST(event_id AS VARCHAR), profile_id, gcid) AS rn
              FROM enriched WHERE reject_reason IS NULL AND route = 'webproject_path') WHERE rn = 1""",
        ENRICHED_CTE,
    ),
    doubles=('asset_deleted_at',),
)
def agg_asset(spark, sf):
    return activations.assets(activations.project_rows(_enriched(spark, sf)))


@check(
    "agg_project",
    with_views(
        ENRICH_VIEWS,
        """SELECT project_id AS id, concat('Project ', project_id) AS name, 'WebProject' AS project_type,
        min_by(profile_id, (ts, CAST(event_id AS VARCHAR), profile_id)) FILTER (WHERE profile_id IS NOT NULL) AS profile_id,
        min_by(gcid, (ts, CAST(event_id AS VARCHAR), gcid)) AS gcid,
        epoch_us(min(ts)) AS created_at, false AS is_deleted, CAST(NULL AS BIGINT) AS project_deleted_at
        FROM enriched WHERE reject_reason IS NULL AND route = 'webproject_path' GROUP BY project_id""",
        ENRICHED_CTE,
    ),
    doubles=('project_deleted_at',),
)
def agg_project(spark, sf):
    return activations.project_summary(activations.project_rows(_enriched(spark, sf)))


@check(
    "agg_daily_usage",
    with_views(
        USAGE_VIEWS,
        """SELECT customer_id, font_id, usage_type_id, CAST(source_system_id AS BIGINT) AS source_system_id,
        CAST(customer_identifier_type_id AS BIGINT) AS customer_identifier_type_id,
        CAST(event_date AS VARCHAR) AS event_date, count(*) AS fu_event_count
        FROM usage GROUP BY ALL""",
        USAGE_CTE,
    ),
)
def agg_daily_usage(spark, sf):
    return activations.daily_usage(activations.enrich_usage(_enriched(spark, sf), lookups(spark, sf)))


NEW_USAGE_CTE = f"""{USAGE_CTE},
new_usage AS (
  SELECT customer_id, font_id, year, month, event_type AS usage_type, 'Connect' AS source_system,
    min(event_date) AS first_usage, max(event_date) AS last_usage, count(*) AS usage_count,
    'GCID' AS customer_identifier_type
  FROM usage GROUP BY customer_id, font_id, year, month, event_type
)"""
ROLLED = """SELECT customer_id, font_id, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, usage_type,
  source_system, CAST(min(first_usage) AS VARCHAR) AS first_usage, CAST(max(last_usage) AS VARCHAR) AS last_usage,
  CAST(sum(usage_count) AS BIGINT) AS usage_count, min(customer_identifier_type) AS customer_identifier_type
  FROM ({0}) GROUP BY customer_id, font_id, year, month, usage_type, source_system"""


def new_usage(spark, sf):
    """New monthly usage, counted before the lookups."""
    counted = activations.count_entries(_entries(spark, sf))
    found = lookups(spark, sf)
    enriched = activations.enrich_entries(counted, found)
    return activations.monthly_usage(activations.enrich_usage(enriched, found), weight="entries")


@check(
    "monthly_merge_rollup",
    with_views(
        f"{USAGE_VIEWS} usage_existing",
        ROLLED.format(
            """SELECT * FROM usage_existing WHERE (year, month) IN (SELECT (year, month) FROM new_usage)
            UNION ALL BY NAME SELECT * FROM new_usage"""
        ),
        NEW_USAGE_CTE,
    ),
)
def monthly_merge_rollup(spark, sf):
    new = materialize(new_usage(spark, sf))
    months = new.select("year", "month").distinct()
    return aggregates.monthly_rollup(
        frame(spark, sf, "usage_existing"),
        new,
        list(activations.MERGE_KEYS),
        "customer_identifier_type",
        months,
    )


@check(
    "event_ingestion_usage",
    with_views(
        f"{USAGE_VIEWS}",
        """SELECT customer_id, font_id, CAST(year AS BIGINT) AS year, CAST(month AS BIGINT) AS month, usage_type,
        source_system, CAST(first_usage AS VARCHAR) AS first_usage, CAST(last_usage AS VARCHAR) AS last_usage,
        usage_count, customer_identifier_type FROM new_usage""",
        NEW_USAGE_CTE,
    ),
)
def event_ingestion_usage(spark, sf):
    return new_usage(spark, sf)


SALES_DECIMAL = "CAST(round(sum(CAST(quantity * unit_price AS DECIMAL(38,10))), 2) AS DOUBLE)"


@check(
    "agg_daily_sales",
    with_views(
        "sales",
        f"""SELECT region, CAST(order_date AS VARCHAR) AS order_date, {SALES_DECIMAL} AS total_revenue,
        count(order_id) AS order_count, {SALES_DECIMAL} / count(quantity * unit_price) AS avg_order_value
        FROM sales GROUP BY region, order_date""",
    ),
)
def agg_daily_sales(spark, sf):
    sales = frame(spark, sf, "sales").withColumn("revenue", F.expr("quantity * unit_price"))
    return aggregates.aggregate(sales, ["region", "order_date"], daily.SALES_METRICS)


FIRST_SALES = """first_sales AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY order_id ORDER BY customer_id, product_id, supplier_id,
    quantity, unit_price, region, order_date, payment_method) AS rn FROM sales) WHERE rn = 1)"""
DAILY_SALES = f"""SELECT region, CAST(order_date AS VARCHAR) AS order_date, {SALES_DECIMAL} AS total_revenue,
        count(order_id) AS order_count, {SALES_DECIMAL} / count(quantity * unit_price) AS avg_order_value
        FROM first_sales GROUP BY region, order_date"""


@check("daily_sales", with_views("sales", DAILY_SALES, FIRST_SALES))
def daily_sales(spark, sf):
    return daily.daily_sales(frame(spark, sf, "sales"))


# Windows


@check(
    "dedup_keep_last",
    with_views(
        "raw_orders",
        """SELECT id, order_id, email FROM (SELECT *, row_number() OVER (PARTITION BY order_id, email
          ORDER BY try_strptime(created_at, '%Y-%m-%d %H:%M:%S') DESC NULLS LAST, id DESC) AS rn FROM raw_orders)
        WHERE rn = 1""",
    ),
)
def dedup_keep_last(spark, sf):
    df = columns.parse_dates(
        frame(spark, sf, "raw_orders"),
        {"created_at": {"format": "%Y-%m-%d %H:%M:%S", "errors": "coerce"}},
    )
    return windows.deduplicate(
        df, ["order_id", "email"], "created_at", keep="last", tiebreak=["id"]
    ).select("id", "order_id", "email")


@check(
    "dedup_keep_first",
    with_views(
        "sales",
        """SELECT order_id, customer_id, product_id, supplier_id, quantity, unit_price, region,
        CAST(order_date AS VARCHAR) AS order_date, payment_method FROM first_sales""",
        FIRST_SALES,
    ),
)
def dedup_keep_first(spark, sf):
    return windows.deduplicate(frame(spark, sf, "sales"), ["order_id"], [], keep="first")


@check("dedup_any", with_views("raw_orders", "SELECT DISTINCT order_id, email FROM raw_orders"))
def dedup_any(spark, sf):
    df = windows.deduplicate_any(frame(spark, sf, "raw_orders"), ["order_id", "email"])
    return df.select("order_id", "email")


SESSION_CTE = """
clicks AS (SELECT * FROM clickstream WHERE device_type IS DISTINCT FROM 'bot'),
flagged AS (SELECT *, CASE WHEN lag(ts) OVER w IS NULL OR epoch_us(ts) - epoch_us(lag(ts) OVER w) > 1800000000
  THEN 1 ELSE 0 END AS starts FROM clicks WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
sessions AS (SELECT *, CAST(sum(starts) OVER (PARTITION BY user_id ORDER BY ts) AS BIGINT) AS session_id FROM flagged)"""
SESSION_METRICS = """count(page_url) AS page_views, (epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 AS session_duration_sec,
  count(DISTINCT page_url) AS unique_pages,
  min_by(device_type, (ts, event_id)) FILTER (WHERE device_type IS NOT NULL) AS device_type"""


def _clicks(spark, sf):
    return frame(spark, sf, "clickstream").withColumnRenamed("ts", "timestamp")


def _people(spark, sf):
    from millrace.operators.filters import exclude_value

    return exclude_value(_clicks(spark, sf), "device_type", "bot")


@check(
    "sessionize",
    with_views("clickstream", "SELECT event_id, user_id, session_id FROM sessions", SESSION_CTE),
)
def sessionize(spark, sf):
    return windows.sessionize(_people(spark, sf), "user_id", "timestamp", 30).select(
        "event_id", "user_id", "session_id"
    )


@check(
    "agg_sessions",
    with_views(
        "clickstream",
        f"SELECT user_id, session_id, {SESSION_METRICS} FROM sessions GROUP BY user_id, session_id",
        SESSION_CTE,
    ),
)
def agg_sessions(spark, sf):
    return aggregates.session_metrics(
        _people(spark, sf), "user_id", "timestamp", "page_url", ["device_type"], ["timestamp", "event_id"]
    )


@check(
    "user_sessions",
    with_views(
        "clickstream users",
        f"""SELECT s.*, account_type, CAST(signup_date AS VARCHAR) AS signup_date, country FROM (
        SELECT user_id, session_id, {SESSION_METRICS} FROM sessions GROUP BY user_id, session_id) s
        LEFT JOIN users USING (user_id)""",
        SESSION_CTE,
    ),
)
def user_sessions(spark, sf):
    return activity.user_sessions(_clicks(spark, sf), frame(spark, sf, "users"))


# Row-skipping checks

REASON = f"""CASE WHEN user_email IS NULL THEN 'required_fields'
  WHEN event_name NOT IN ('permanentActivation', 'temporaryActivation', 'riskScan', 'autoActivation', 'addedToLibrary')
  THEN 'event_type' WHEN fonts_n = 0 THEN 'font_list' END"""


@check(
    "qc_skip_required",
    with_views(
        "activation_flat",
        "SELECT CAST(event_id AS VARCHAR) AS event_id FROM activation_flat WHERE user_email IS NOT NULL",
    ),
)
def qc_skip_required(spark, sf):
    parsed = columns.parse_image(images(spark, sf))
    rule = quality.complete(["mtf_id", "user", "timestamp", "event_type"])
    return quality.valid_rows(quality.mark_rejects(parsed, [("required_fields", rule)])).select("event_id")


@check(
    "qc_skip_event_type",
    with_views(
        "activation_flat",
        """SELECT CAST(event_id AS VARCHAR) AS event_id, event_name AS event_type FROM activation_flat
        WHERE event_name IN
        ('permanentActivation', 'temporaryActivation', 'riskScan', 'autoActivation', 'addedToLibrary')""",
    ),
)
def qc_skip_event_type(spark, sf):
    parsed = columns.parse_image(images(spark, sf))
    rule = F.col("event_type").isin(list(activations.EVENT_TYPES))
    return quality.valid_rows(quality.mark_rejects(parsed, [("event_type", rule)])).select(
        "event_id", "event_type"
    )


@check(
    "qc_skip_empty_list",
    with_views("activation_flat", "SELECT CAST(event_id AS VARCHAR) AS event_id FROM activation_flat WHERE fonts_n > 0"),
)
def qc_skip_empty_list(spark, sf):
    marked = quality.mark_rejects(images(spark, sf), [("font_list", any_list_filled(RECORD_PATH))])
    return quality.valid_rows(marked).select(F.col("eventID").alias("event_id"))


@check(
    "qc_skip_unresolved",
    with_views(
        ENRICH_VIEWS,
        """SELECT CAST(event_id AS VARCHAR) AS event_id, fontsense_id, gcid, profile_id FROM enriched
        WHERE gcid IS NOT NULL AND profile_id IS NOT NULL""",
        ENRICHED_CTE,
    ),
)
def qc_skip_unresolved(spark, sf):
    enriched = _enriched(spark, sf).drop("reject_reason")
    rule = quality.complete(["gcid", "profile_id"])
    return quality.valid_rows(quality.mark_rejects(enriched, [("lookup", rule)])).select(
        "event_id", "fontsense_id", "gcid", "profile_id"
    )


@check(
    "qc_skip_usage",
    with_views(
        USAGE_VIEWS,
        "SELECT customer_id, font_id, CAST(event_date AS VARCHAR) AS event_date, count(*) AS n FROM usage GROUP BY ALL",
        USAGE_CTE,
    ),
)
def qc_skip_usage(spark, sf):
    usage = activations.enrich_usage(_enriched(spark, sf), lookups(spark, sf))
    return aggregates.count_rows(quality.valid_rows(usage), ["customer_id", "font_id", "event_date"], "n")


@check(
    "run_counters",
    with_views(
        "activation_flat",
        f"""SELECT count(*) AS raw_count, CAST(count_if(r IS NULL OR r NOT IN ('required_fields', 'event_type')) AS BIGINT) AS eligible_count,
        CAST(count_if(r IS NULL) AS BIGINT) AS processed_count, CAST(count_if(r IS NOT NULL) AS BIGINT) AS skipped_count
        FROM (SELECT {REASON} AS r FROM activation_flat)""",
    ),
)
def run_counters(spark, sf):
    from millrace.control.runs import counters

    early = [activations.MISSING_FIELD, activations.WRONG_TYPE]
    return counters(activations.parse_records(images(spark, sf)), early)
