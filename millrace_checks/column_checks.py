"""Projections, filters and single-table pipelines."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace_checks.fixtures import frame, table, with_views
from millrace_checks.registry import check
from millrace.functions.text import uuid_text
from millrace.operators import columns, filters
from millrace.plans import daily, orders
from millrace.plans.runner import apply_steps, register_step

EMAIL_CLEAN = "lower(regexp_replace(email, '^\\s+|\\s+$', '', 'g'))"
DOMAIN = "string_split(email, '@')[2]"
STAMP = "try_strptime({0}, '%Y-%m-%d %H:%M:%S')"


@check(
    "select_columns",
    with_views(
        "raw_orders", "SELECT id, order_name, email, CAST(NULL AS VARCHAR) AS process_at_date FROM raw_orders"
    ),
)
def select_columns(spark, sf):
    return columns.select_columns(
        frame(spark, sf, "raw_orders"), ["id", "order_name", "email", "process_at_date"]
    )


@check(
    "drop_columns",
    with_views(
        "raw_orders",
        """SELECT id, created_at, process_at, last_attempt_on, order_id, order_name, email, attempt_count,
        status, font_name, variant_title, source_name, product_type, font_identifier FROM raw_orders""",
    ),
)
def drop_columns(spark, sf):
    return columns.drop_columns(
        frame(spark, sf, "raw_orders"), ["skuid", "eula_id", "is_reprocessed", "md5", "not_there"]
    )


@check(
    "rename_columns",
    with_views(
        "raw_orders",
        "SELECT id AS order_record_id, order_id AS shopify_order_id, attempt_count AS total_attempts FROM raw_orders",
    ),
)
def rename_columns(spark, sf):
    df = frame(spark, sf, "raw_orders").select("id", "order_id", "attempt_count")
    return columns.rename_columns(
        df,
        {
            "id": "order_record_id",
            "order_id": "shopify_order_id",
            "attempt_count": "total_attempts",
            "process_at_date": "processed_date",
        },
    )


@check("derive_domain", with_views("raw_orders", f"SELECT id, {DOMAIN} AS domain FROM raw_orders"))
def derive_domain(spark, sf):
    return columns.derive_domain(frame(spark, sf, "raw_orders"), "email", "domain").select("id", "domain")


@check(
    "derive_domain_default",
    with_views("raw_orders", f"SELECT id, coalesce({DOMAIN}, 'unknown') AS email_domain FROM raw_orders"),
)
def derive_domain_default(spark, sf):
    df = frame(spark, sf, "raw_orders")
    return columns.derive_domain(df, "email", "email_domain", "unknown").select("id", "email_domain")


@check(
    "derive_expr",
    with_views("raw_orders", "SELECT id, upper(order_id || '/' || order_name) AS label FROM raw_orders"),
)
def derive_expr(spark, sf):
    df = frame(spark, sf, "raw_orders")
    return columns.derive_column(df, "label", "upper(concat(order_id, '/', order_name))").select("id", "label")


@check(
    "derive_year_month",
    """SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS order_year,
    CAST(month(o_orderdate) AS BIGINT) AS order_month FROM orders""",
)
def derive_year_month(spark, sf):
    return apply_steps(
        table(spark, sf, "orders"),
        [
            {"derive_column": {"target_field": "order_year", "expression": "year(o_orderdate)"}},
            {"derive_column": {"target_field": "order_month", "expression": "month(o_orderdate)"}},
        ],
    ).select("o_orderkey", "order_year", "order_month")


@check(
    "derive_lag_days",
    with_views(
        "raw_orders",
        f"""SELECT id, (epoch_us({STAMP.format('process_at')}) - epoch_us({STAMP.format('created_at')}))
        / 86400e6 AS processing_lag_days FROM raw_orders""",
    ),
)
def derive_lag_days(spark, sf):
    parsed = columns.parse_dates(
        frame(spark, sf, "raw_orders"), {"created_at": orders.DATE_FORMAT, "process_at": orders.DATE_FORMAT}
    )
    return columns.derive_lag_days(parsed, "processing_lag_days", "created_at", "process_at").select(
        "id", "processing_lag_days"
    )


@check(
    "derive_flag",
    with_views(
        "raw_orders",
        """SELECT id, coalesce(is_reprocessed = 1, false) OR coalesce(CAST(attempt_count AS BIGINT) > 1, false)
        AS is_reprocessed_flag FROM raw_orders""",
    ),
)
def derive_flag(spark, sf):
    df = columns.cast_types(frame(spark, sf, "raw_orders"), {"attempt_count": "int"})
    flagged = columns.derive_flag(df, "is_reprocessed_flag", ["is_reprocessed = 1", "attempt_count > 1"])
    return flagged.select("id", "is_reprocessed_flag")


@check(
    "derive_revenue",
    """SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey,
    l_quantity * l_extendedprice AS revenue FROM lineitem""",
)
def derive_revenue(spark, sf):
    step = {"calculate_revenue": {"formula": "l_quantity * l_extendedprice", "output_column": "revenue"}}
    return apply_steps(table(spark, sf, "lineitem"), [step]).select(
        "l_orderkey", "l_linenumber", "l_partkey", "revenue"
    )


@check("derive_celsius", with_views("weather", "SELECT id, (temp_f - 32) * 5 / 9 AS temp_c FROM weather"))
def derive_celsius(spark, sf):
    return apply_steps(frame(spark, sf, "weather"), daily.WEATHER_STEPS[:1]).select("id", "temp_c")


@check(
    "conditional_provider",
    with_views(
        "raw_orders",
        f"""SELECT id, CASE WHEN d = 'gmail.com' THEN 'Gmail'
        WHEN d IN ('outlook.com', 'hotmail.com', 'live.com') THEN 'Microsoft'
        WHEN contains(d, 'yahoo') THEN 'Yahoo' ELSE 'Corporate' END AS email_provider
        FROM (SELECT id, string_split({EMAIL_CLEAN}, '@')[2] AS d FROM raw_orders)""",
    ),
)
def conditional_provider(spark, sf):
    df = columns.clean_strings(frame(spark, sf, "raw_orders"), ["email"])
    return apply_steps(df, orders.ANALYTICS_STEPS[3:5]).select("id", "email_provider")


@check(
    "conditional_status_group",
    with_views(
        "raw_orders",
        """SELECT id, CASE WHEN status = 'success' THEN 'completed'
        WHEN status IN ('load', 'pending', 'processing') THEN 'in_progress' ELSE 'other' END AS status_group
        FROM raw_orders""",
    ),
)
def conditional_status_group(spark, sf):
    return apply_steps(frame(spark, sf, "raw_orders"), orders.SUMMARY_STEPS[5:6]).select("id", "status_group")


@check(
    "bucket_attempts",
    with_views(
        "raw_orders",
        """SELECT id, CASE WHEN n BETWEEN 0 AND 0 THEN 'no_attempts' WHEN n BETWEEN 1 AND 1 THEN 'single'
        WHEN n BETWEEN 2 AND 3 THEN 'moderate' WHEN n >= 4 THEN 'high' END AS attempt_bucket
        FROM (SELECT id, CAST(attempt_count AS BIGINT) AS n FROM raw_orders)""",
    ),
)
def bucket_attempts(spark, sf):
    df = columns.cast_types(frame(spark, sf, "raw_orders"), {"attempt_count": "int"})
    return apply_steps(df, orders.ANALYTICS_STEPS[5:6]).select("id", "attempt_bucket")


@check(
    "clean_strings",
    with_views(
        "raw_orders",
        f"""SELECT id, {EMAIL_CLEAN} AS email, lower(trim(font_name)) AS font_name,
        lower(variant_title) AS variant_title FROM raw_orders""",
    ),
)
def clean_strings(spark, sf):
    df = columns.clean_strings(
        frame(spark, sf, "raw_orders"), ["email", "font_name", "variant_title", "not_there"]
    )
    return df.select("id", "email", "font_name", "variant_title")


@check(
    "parse_dates",
    with_views(
        "raw_orders",
        f"""SELECT id, epoch_us({STAMP.format('created_at')}) AS created_at,
        epoch_us({STAMP.format('process_at')}) AS process_at FROM raw_orders""",
    ),
    doubles=('created_at',),
)
def parse_dates(spark, sf):
    strict = {"format": "%Y-%m-%d %H:%M:%S", "errors": "raise"}
    df = columns.parse_dates(
        frame(spark, sf, "raw_orders"), {"created_at": orders.DATE_FORMAT, "process_at": strict}
    )
    return df.select("id", "created_at", "process_at")


@check(
    "cast_types",
    with_views(
        "raw_orders",
        "SELECT CAST(id AS VARCHAR) AS id, CAST(attempt_count AS BIGINT) AS attempt_count FROM raw_orders",
    ),
    doubles=('attempt_count',),
)
def cast_types(spark, sf):
    df = columns.cast_types(frame(spark, sf, "raw_orders"), {"id": "str", "attempt_count": "int"})
    return df.select("id", "attempt_count")


@check(
    "cast_template",
    """SELECT c_custkey, '2024-02-03' AS day, round(CAST(CAST(c_acctbal / 3 AS VARCHAR) AS DOUBLE), 2) AS amount,
    c_name FROM customer""",
)
def cast_template(spark, sf):
    df = table(spark, sf, "customer").select(
        "c_custkey",
        F.lit("2024-02-03 04:05:06").alias("day"),
        (F.col("c_acctbal") / 3).cast("string").alias("amount"),
        "c_name",
    )
    return columns.cast_template(df, {"day": "date", "amount": "decimal(10,2)", "c_name": "varchar"})


@check(
    "fill_nulls",
    with_views(
        "raw_orders",
        """SELECT id, coalesce(email, 'unknown@unknown.com') AS email, coalesce(variant_title, 'N/A') AS variant_title,
        coalesce(CAST(attempt_count AS BIGINT), 0) AS attempt_count FROM raw_orders""",
    ),
)
def fill_nulls(spark, sf):
    df = columns.cast_types(frame(spark, sf, "raw_orders"), {"attempt_count": "int"})
    filled = columns.fill_nulls(
        df,
        {"email": "unknown@unknown.com", "variant_title": "N/A", "attempt_count": 0, "not_there": 1},
    )
    return filled.select("id", "email", "variant_title", "attempt_count")


@check(
    "static_columns",
    """SELECT event_id, 'NA' AS source, 'NA' AS subtype, '2024-02-01' AS load_date FROM events""",
)
def static_columns(spark, sf):
    import datetime

    df = table(spark, sf, "events").select("event_id")
    return columns.static_columns(
        df, {"source": "NA", "subtype": "NA", "load_date": datetime.date(2024, 2, 1)}
    )


@check(
    "binary_to_uuid",
    """SELECT c_custkey, concat('00000000-0000-0000-0000-', lpad(CAST(c_custkey AS VARCHAR), 12, '0')) AS profile_id
    FROM customer""",
)
def binary_to_uuid(spark, sf):
    binary = F.unhex(F.lpad(F.col("c_custkey").cast("string"), 32, "0"))
    return table(spark, sf, "customer").select("c_custkey", uuid_text(binary).alias("profile_id"))


@check(
    "filter_rows",
    with_views("raw_orders", "SELECT id, status FROM raw_orders WHERE status IS DISTINCT FROM 'failed'"),
)
def filter_rows(spark, sf):
    df = frame(spark, sf, "raw_orders")
    return apply_steps(df, [{"filter_rows": {"condition": "status != 'failed'"}}]).select("id", "status")


@check(
    "filter_bots",
    with_views(
        "clickstream", "SELECT event_id, device_type FROM clickstream WHERE device_type IS DISTINCT FROM 'bot'"
    ),
)
def filter_bots(spark, sf):
    df = frame(spark, sf, "clickstream")
    return apply_steps(df, [{"filter_bots": {"condition": "device_type != 'bot'"}}]).select(
        "event_id", "device_type"
    )


@check(
    "filter_event_types",
    with_views(
        "activation_flat",
        """SELECT event_id, event_name FROM activation_flat WHERE event_name IN
        ('permanentActivation', 'temporaryActivation', 'riskScan', 'autoActivation', 'addedToLibrary')""",
    ),
)
def filter_event_types(spark, sf):
    from millrace.plans.activations import EVENT_TYPES

    df = frame(spark, sf, "activation_flat")
    return filters.keep_values(df, "event_name", EVENT_TYPES).select("event_id", "event_name")


@check(
    "drop_incomplete",
    with_views("weather", "SELECT id, city, temp_f FROM weather WHERE city IS NOT NULL AND temp_f IS NOT NULL"),
)
def drop_incomplete(spark, sf):
    return filters.drop_incomplete(frame(spark, sf, "weather"), ["date", "city", "temp_f"]).select(
        "id", "city", "temp_f"
    )


@check("custom_step", "SELECT o_orderkey, o_totalprice * 2 AS doubled FROM orders")
def custom_step(spark, sf):
    register_step("double_price", lambda df, p: df.withColumn(p["into"], F.col("o_totalprice") * 2))
    return apply_steps(table(spark, sf, "orders"), [{"double_price": {"into": "doubled"}}]).select(
        "o_orderkey", "doubled"
    )


ANALYTICS_ORACLE = with_views(
    "raw_orders",
    """SELECT id AS order_record_id, epoch_us(created_at) AS order_created_at,
      epoch_us(process_at) AS order_processed_at, order_id AS shopify_order_id, order_name AS shopify_order_name,
      email, email_domain, email_provider, variant_title, font_name, font_identifier AS font_id, source_name,
      product_type, status, attempt_count AS total_attempts, attempt_bucket,
      epoch_us(last_attempt_on) AS last_attempt_date, is_reprocessed_flag, processing_lag_days,
      CAST(NULL AS VARCHAR) AS processed_date
    FROM ranked WHERE rn = 1 AND status IS DISTINCT FROM 'failed'""",
    f"""cleaned AS (
      SELECT id, {STAMP.format('created_at')} AS created_at, {STAMP.format('process_at')} AS process_at,
        {STAMP.format('last_attempt_on')} AS last_attempt_on, order_id, order_name, {EMAIL_CLEAN} AS email,
        CAST(attempt_count AS BIGINT) AS attempt_count, status, is_reprocessed, lower(trim(font_name)) AS font_name,
        lower(variant_title) AS variant_title, lower(source_name) AS source_name,
        lower(product_type) AS product_type, font_identifier
      FROM raw_orders),
    derived AS (SELECT *, {DOMAIN} AS d FROM cleaned),
    filled AS (
      SELECT id, created_at, process_at, last_attempt_on, order_id, order_name,
        coalesce(email, 'unknown@unknown.com') AS email, coalesce(d, 'unknown') AS email_domain,
        CASE WHEN d = 'gmail.com' THEN 'Gmail' WHEN d IN ('outlook.com', 'hotmail.com', 'live.com') THEN 'Microsoft'
             WHEN contains(d, 'yahoo') THEN 'Yahoo' ELSE 'Corporate' END AS email_provider,
        CASE WHEN attempt_count = 0 THEN 'no_attempts' WHEN attempt_count = 1 THEN 'single'
             WHEN attempt_count BETWEEN 2 AND 3 THEN 'moderate' WHEN attempt_count >= 4 THEN 'high' END AS attempt_bucket,
        coalesce((epoch_us(process_at) - epoch_us(created_at)) / 86400e6, -1.0) AS processing_lag_days,
        coalesce(is_reprocessed = 1, false) OR coalesce(attempt_count > 1, false) AS is_reprocessed_flag,
        coalesce(attempt_count, 0) AS attempt_count, font_name, coalesce(variant_title, 'N/A') AS variant_title,
        source_name, product_type, font_identifier, status
      FROM derived),
    ranked AS (
      SELECT *, row_number() OVER (PARTITION BY order_id, email ORDER BY created_at DESC NULLS LAST, id DESC) AS rn
      FROM filled)""",
)


@check("order_analytics", ANALYTICS_ORACLE,
    doubles=('order_created_at',),
)
def order_analytics(spark, sf):
    return orders.order_analytics(frame(spark, sf, "raw_orders"))


@check(
    "order_summary",
    with_views(
        "raw_orders",
        f"""SELECT id, epoch_us(created) AS created_at, CAST(year(created) AS BIGINT) AS order_year,
        CAST(month(created) AS BIGINT) AS order_month, order_id, order_name, email,
        coalesce({DOMAIN}, 'unknown') AS email_domain, font_name, product_type, status,
        CASE WHEN status = 'success' THEN 'completed'
        WHEN status IN ('load', 'pending', 'processing') THEN 'in_progress' ELSE 'other' END AS status_group,
        attempt_count, CAST(is_reprocessed AS BIGINT) AS is_reprocessed
        FROM (SELECT * REPLACE ({EMAIL_CLEAN} AS email), {STAMP.format('created_at')} AS created FROM raw_orders)""",
    ),
    doubles=('created_at', 'order_year', 'order_month', 'is_reprocessed'),
)
def order_summary(spark, sf):
    return orders.order_summary(frame(spark, sf, "raw_orders"))


@check(
    "shop_to_demo",
    with_views(
        "raw_orders",
        f"""SELECT id, created_at, process_at, order_id, order_name, email, {DOMAIN} AS domain, variant_title,
        font_name, md5, source_name, status, attempt_count, last_attempt_on,
        CAST(is_reprocessed AS BIGINT) AS is_reprocessed, product_type, font_identifier,
        CAST(NULL AS VARCHAR) AS process_at_date FROM raw_orders""",
    ),
    doubles=('is_reprocessed',),
)
def shop_to_demo(spark, sf):
    return orders.order_copy(frame(spark, sf, "raw_orders"))


@check(
    "customer_details",
    with_views("customers", f"SELECT name, email, address, orgName, {DOMAIN} AS domain FROM customers"),
)
def customer_details(spark, sf):
    return orders.customer_details(frame(spark, sf, "customers"))


@check(
    "weather",
    with_views(
        "weather",
        """SELECT CAST(date AS VARCHAR) AS date, city, (temp_f - 32) * 5 / 9 AS temp_c,
        CAST(humidity AS BIGINT) AS humidity, CAST(wind_speed AS BIGINT) AS wind_speed
        FROM weather WHERE city IS NOT NULL AND temp_f IS NOT NULL""",
    ),
)
def weather(spark, sf):
    return daily.weather(frame(spark, sf, "weather"))
