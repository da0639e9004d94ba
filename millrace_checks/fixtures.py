"""Views over the driver's tables with the shapes the operators take.

The same text runs on both engines: ``{orders}`` is a table. NULLs, misses, duplicates and
bad values are there on purpose.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.images import image_schema
from millrace.functions.text import uuid_text
from millrace.plans.activations import prepare_lookups
from millrace.session import shared_folder

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()

VIEWS = {
    "raw_orders": """
SELECT o_orderkey AS id,
  CASE WHEN o_orderkey % 17 = 0 THEN 'not a date' WHEN o_orderkey % 19 = 0 THEN NULL
       ELSE CAST(o_orderdate AS STRING) END AS created_at,
  CAST(CASE WHEN o_orderkey % 4 = 0 THEN o_orderdate + INTERVAL '36' HOUR
            WHEN o_orderkey % 4 = 1 THEN o_orderdate + INTERVAL '12' HOUR
            ELSE o_orderdate END AS STRING) AS process_at,
  CAST(o_orderdate AS STRING) AS last_attempt_on,
  concat('A', CAST(o_custkey AS STRING)) AS order_id,
  concat('#', CAST(o_orderkey AS STRING)) AS order_name,
  CASE WHEN o_custkey % 13 = 0 THEN NULL
       WHEN o_custkey % 11 = 0 THEN 'no-at-sign'
       WHEN o_custkey % 7 = 0 THEN concat('  User', CAST(o_custkey AS STRING), '@GMAIL.com ')
       WHEN o_custkey % 5 = 0 THEN concat('u', CAST(o_custkey AS STRING), '@hotmail.com')
       WHEN o_custkey % 3 = 0 THEN concat('u', CAST(o_custkey AS STRING), '@yahoo.co.uk')
       WHEN o_custkey % 2 = 0 THEN concat('u', CAST(o_custkey AS STRING), '@a.example@b.example')
       ELSE concat('u', CAST(o_custkey AS STRING), '@corp.example') END AS email,
  CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderkey % 6 AS STRING) END AS attempt_count,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL WHEN o_orderstatus = 'F' THEN 'success'
       WHEN o_orderstatus = 'O' THEN 'pending' ELSE 'failed' END AS status,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL WHEN o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS is_reprocessed,
  concat('  Font ', CAST(o_orderkey % 50 AS STRING), ' ') AS font_name,
  CASE WHEN o_orderkey % 10 = 0 THEN NULL ELSE 'Regular' END AS variant_title,
  'Web' AS source_name, o_orderpriority AS product_type,
  CAST(o_orderkey AS STRING) AS font_identifier,
  'sku' AS skuid, 'eula' AS eula_id, 'md5' AS md5
FROM {orders}
""",
    "customers": """
SELECT c_custkey AS id, c_name AS name,
  CASE WHEN c_custkey % 10 = 0 THEN NULL ELSE concat(c_name, '@', c_mktsegment, '.example') END AS email,
  n_name AS address, c_mktsegment AS orgName
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
""",
    "sales": """
SELECT l_orderkey * 10 + l_linenumber AS order_id, o_custkey AS customer_id, l_partkey AS product_id,
  l_suppkey AS supplier_id, l_quantity AS quantity, l_extendedprice AS unit_price, r_name AS region,
  CAST(l_shipdate AS DATE) AS order_date, l_returnflag AS payment_method
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey JOIN {customer} ON o_custkey = c_custkey
JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
""",
    "weather": """
SELECT c_custkey AS id, CAST(DATE '2024-01-01' AS DATE) AS date,
  CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE n_name END AS city,
  CASE WHEN c_custkey % 8 = 0 THEN NULL ELSE c_acctbal / 100 END AS temp_f,
  CAST(c_custkey % 100 AS INT) AS humidity, CAST(c_custkey % 30 AS INT) AS wind_speed
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey
""",
    "clickstream": """
SELECT event_id, user_id, ts, event_type,
  CASE WHEN event_type = 'signup' THEN NULL
       ELSE concat('/', event_type, '/', CAST(event_id % 7 AS STRING)) END AS page_url,
  CASE WHEN user_id % 10 = 0 THEN 'bot' WHEN event_type = 'error' THEN NULL ELSE 'web' END AS device_type
FROM {events}
""",
    "users": """
SELECT c_custkey AS user_id, c_mktsegment AS account_type, DATE '2023-01-01' AS signup_date, n_name AS country
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey WHERE c_custkey % 9 <> 0
""",
    "activation_flat": """
SELECT event_id, ts,
  CASE event_type WHEN 'click' THEN 'permanentActivation' WHEN 'view' THEN 'temporaryActivation'
       WHEN 'purchase' THEN 'riskScan' WHEN 'signup' THEN 'addedToLibrary' ELSE 'unknownType' END AS event_name,
  CASE WHEN event_id % 41 = 0 THEN NULL ELSE concat('u', CAST(user_id AS STRING), '@mail.example') END AS user_email,
  concat('auth0|', CAST(user_id AS STRING)) AS mtf_id,
  CASE WHEN event_id % 37 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 2 ELSE 1 END AS fonts_n,
  CASE WHEN event_id % 2 = 0 THEN event_id % 260 ELSE 100000 + event_id % 260 END AS fontsense_id,
  CASE WHEN event_type = 'signup' AND event_id % 4 < 2 THEN concat('P', CAST(event_id % 25 AS STRING)) END AS project_id,
  CASE WHEN event_type = 'signup' AND event_id % 4 < 2
       THEN CASE WHEN event_id % 5 = 0 THEN 'MobileProject' ELSE 'WebProject' END END AS project_type
FROM {events}
""",
    "identity_map": """
SELECT concat('auth0|', CAST(c_custkey AS STRING)) AS identity_provider_id,
  concat('GC', CAST(c_custkey AS STRING)) AS customer_id
FROM {customer} WHERE c_custkey % 9 <> 0
""",
    "profiles": """
SELECT concat('u', CAST(c_custkey AS STRING), '@mail.example') AS email,
  concat('GC', CAST(c_custkey AS STRING)) AS customer_id,
  lpad(CAST(c_custkey AS STRING), 32, '0') AS profile_hex
FROM {customer} WHERE c_custkey % 7 <> 0
""",
    "font_style": """
SELECT p_partkey AS font_style_id, p_partkey + 100000 AS pimid, p_size AS family_id
FROM {part} WHERE p_partkey % 6 <> 0
""",
    "font": """
SELECT p_partkey + 5000 AS font_id, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS fontsense_id,
  concat('PS-', CAST(p_partkey AS STRING)) AS ps_name
FROM {part}
""",
    "usage_existing": """
SELECT concat('GC', CAST(user_id AS STRING)) AS customer_id, event_id % 260 + 5000 AS font_id,
  CAST(CASE WHEN event_id % 2 = 0 THEN 2023 ELSE 2024 END AS INT) AS year,
  CAST(CASE WHEN event_id % 2 = 0 THEN 12 ELSE 1 END AS INT) AS month,
  'permanentActivation' AS usage_type, 'Connect' AS source_system,
  MIN(CASE WHEN event_id % 2 = 0 THEN DATE '2023-12-05' ELSE DATE '2024-01-02' END) AS first_usage,
  MAX(CASE WHEN event_id % 2 = 0 THEN DATE '2023-12-20' ELSE DATE '2024-01-03' END) AS last_usage,
  count(*) AS usage_count, 'GCID' AS customer_identifier_type
FROM {events} WHERE event_id % 5 = 0
GROUP BY user_id, event_id % 260, event_id % 2
""",
    # Type names to ids. One region stands for the source system and identifier type in use.
    "usage_types": """
SELECT CASE event_type WHEN 'click' THEN 'permanentActivation' WHEN 'view' THEN 'temporaryActivation'
       WHEN 'purchase' THEN 'riskScan' WHEN 'signup' THEN 'addedToLibrary' ELSE 'unknownType' END AS name,
  MIN(event_id) + 1 AS id
FROM {events} GROUP BY 1
""",
    "source_systems": """
SELECT CASE WHEN r_regionkey = 0 THEN 'Connect' ELSE r_name END AS name, r_regionkey + 10 AS id FROM {region}
""",
    "identifier_types": """
SELECT CASE WHEN r_regionkey = 1 THEN 'GCID' ELSE r_name END AS name, r_regionkey + 20 AS id FROM {region}
""",
}


# Declared schemas: reading a table takes no inference job.
SCHEMAS = {
    "region": "r_regionkey INT, r_name STRING",
    "nation": "n_nationkey INT, n_name STRING, n_regionkey INT",
    "customer": "c_custkey BIGINT, c_name STRING, c_nationkey INT, c_acctbal DOUBLE, c_mktsegment STRING",
    "part": """p_partkey BIGINT, p_name STRING, p_brand STRING, p_type STRING, p_size INT,
      p_retailprice DOUBLE""",
    "orders": """o_orderkey BIGINT, o_custkey BIGINT, o_orderstatus STRING, o_totalprice DOUBLE,
      o_orderdate TIMESTAMP, o_orderpriority STRING""",
    "lineitem": """l_orderkey BIGINT, l_partkey BIGINT, l_suppkey BIGINT, l_linenumber INT, l_quantity DOUBLE,
      l_extendedprice DOUBLE, l_discount DOUBLE, l_tax DOUBLE, l_returnflag STRING, l_linestatus STRING,
      l_shipdate TIMESTAMP""",
    "events": "event_id BIGINT, ts TIMESTAMP, user_id BIGINT, event_type STRING, value DOUBLE, props STRING",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf_dir}/{name}.parquet")


def frame(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view as a Spark frame."""
    text = VIEWS[view]
    names = set(re.findall(r"\{(\w+)\}", text))
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


def with_views(views: str, body: str, more: str = "") -> str:
    """Oracle SQL: the named views (and further CTEs) in front of ``body``."""
    plain_names = {n: n for n in TABLES}
    parts = [f"{v} AS ({VIEWS[v].format_map(plain_names)})" for v in views.split()]
    if more:
        parts.append(more)
    return f"WITH {', '.join(parts)} {body}"


# Event images as nested records. Entry j of an event is font `fontsense_id + j`.
IMAGES = """
SELECT CAST(event_id AS STRING) AS eventID, named_struct('NewImage', named_struct(
  'eventName', named_struct('S', event_name),
  'userEmail', named_struct('S', user_email),
  'mtfid', named_struct('S', mtf_id),
  'timestamp', named_struct('S', CAST(ts AS STRING)),
  'projectId', named_struct('S', project_id),
  'projectName', named_struct('S', concat('Project ', project_id)),
  'projectType', named_struct('S', project_type),
  'assetType', named_struct('S', CASE WHEN project_id IS NOT NULL THEN 'font' END),
  'adobeFonts', named_struct('L', CASE WHEN event_id % 2 = 0 THEN entries END),
  'teamFonts', named_struct('L', CASE WHEN event_id % 2 = 1 THEN entries END),
  'personalFonts', named_struct('L', CAST(NULL AS ARRAY<STRUCT<S: STRING>>)),
  'systemFonts', named_struct('L', CAST(NULL AS ARRAY<STRUCT<S: STRING>>)),
  'riskScanFonts', named_struct('L', CAST(NULL AS ARRAY<STRUCT<S: STRING>>))
)) AS dynamodb
FROM (
  SELECT *, slice(array(
    named_struct('S', concat('PS-', fontsense_id % 100000, ':XTS:1:XTS:2:XTS:3:XTS:4:XTS:', fontsense_id, ':XTS:0')),
    named_struct('S', concat('PS-', (fontsense_id + 1) % 100000, ':XTS:1:XTS:2:XTS:3:XTS:4:XTS:', fontsense_id + 1, ':XTS:1'))
  ), 1, fonts_n) AS entries
  FROM {activation_flat}
)
"""


_image_folders: dict[tuple[str, str], str] = {}


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The images of all events as a nested table, the shape a feed has after landing.

    Derived from ``events`` once per session and table folder; several files, so that a
    read is as parallel as one of a landed feed. The narrow events are dealt, so that the images
    are built by all tasks, however few row groups the table has.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _image_folders:
        path = shared_folder(spark, "images")
        events = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type")
        flat = spark.sql(VIEWS["activation_flat"], events=events.repartition(spark.sparkContext.defaultParallelism))
        spark.sql(IMAGES, activation_flat=flat).write.parquet(path)
        _image_folders[key] = path
    return spark.read.schema(image_schema()).parquet(_image_folders[key])


LOOKUP_VIEWS = {
    "customers": "identity_map",
    "profiles": "profiles",
    "styles": "font_style",
    "fonts": "font",
    "usage_types": "usage_types",
    "source_systems": "source_systems",
    "identifier_types": "identifier_types",
}
_prepared: dict[tuple[str, str], dict[str, DataFrame]] = {}


def lookups(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The prepared lookups of the activation pipeline, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _prepared:
        raw = {name: frame(spark, sf_dir, view) for name, view in LOOKUP_VIEWS.items()}
        raw["profiles"] = raw["profiles"].select(
            "email", "customer_id", uuid_text(F.unhex("profile_hex")).alias("profile_id")
        )
        _prepared[key] = prepare_lookups(raw)
    return _prepared[key]


# Oracle side of the activation pipeline.
PROFILE_ID = (
    "concat(substr(profile_hex, 1, 8), '-', substr(profile_hex, 9, 4), '-', substr(profile_hex, 13, 4), "
    "'-', substr(profile_hex, 17, 4), '-', substr(profile_hex, 21, 12))"
)
ELIGIBLE = """user_email IS NOT NULL AND fonts_n > 0 AND event_name IN
  ('permanentActivation', 'temporaryActivation', 'riskScan', 'autoActivation', 'addedToLibrary')"""
ENTRY_CTE = f"""
entries AS (
  SELECT a.event_id, a.ts, a.event_name AS event_type, a.user_email, a.mtf_id, a.project_id,
    a.fontsense_id + t.j AS fontsense_id,
    concat('PS-', CAST((a.fontsense_id + t.j) % 100000 AS VARCHAR)) AS ps_name,
    CASE WHEN a.event_name = 'addedToLibrary' AND a.project_type = 'WebProject' AND a.project_id IS NOT NULL
         THEN 'webproject_path' ELSE 'sync_download_path' END AS route,
    CAST(a.ts AS DATE) AS event_date
  FROM activation_flat a JOIN (VALUES (0), (1)) t(j) ON t.j < a.fonts_n
  WHERE {ELIGIBLE}
)"""
ENRICHED_CTE = f"""{ENTRY_CTE},
enriched_all AS (
  SELECT e.*, i.customer_id AS gcid, {PROFILE_ID} AS profile_id_raw, p.email AS profile_hit,
    coalesce(s1.font_style_id, s2.font_style_id) AS font_style_id,
    CASE WHEN s1.font_style_id IS NOT NULL THEN s1.family_id ELSE s2.family_id END AS family_id
  FROM entries e
  LEFT JOIN identity_map i ON i.identity_provider_id = e.mtf_id
  LEFT JOIN profiles p ON p.email = e.user_email AND p.customer_id = i.customer_id
  LEFT JOIN font_style s1 ON s1.font_style_id = e.fontsense_id
  LEFT JOIN font_style s2 ON s2.pimid = e.fontsense_id
),
enriched AS (
  SELECT *, CASE WHEN profile_hit IS NOT NULL THEN profile_id_raw END AS profile_id,
    CASE WHEN gcid IS NULL THEN 'gcid' WHEN font_style_id IS NULL THEN 'font_style'
         WHEN profile_hit IS NULL AND route <> 'webproject_path' THEN 'profile' END AS reject_reason
  FROM enriched_all
)"""
USAGE_CTE = f"""{ENRICHED_CTE},
usage AS (
  SELECT e.event_type, e.event_date, e.gcid AS customer_id, coalesce(f1.font_id, f2.font_id) AS font_id,
    u.id AS usage_type_id, ss.id AS source_system_id, it.id AS customer_identifier_type_id,
    year(e.event_date) AS year, month(e.event_date) AS month
  FROM enriched e
  LEFT JOIN font f1 ON f1.fontsense_id = e.fontsense_id
  LEFT JOIN font f2 ON f2.ps_name = e.ps_name
  LEFT JOIN usage_types u ON u.name = e.event_type
  LEFT JOIN source_systems ss ON ss.name = 'Connect'
  LEFT JOIN identifier_types it ON it.name = 'GCID'
  WHERE e.gcid IS NOT NULL AND e.font_style_id IS NOT NULL
    AND coalesce(f1.font_id, f2.font_id) IS NOT NULL
)"""
ENRICH_VIEWS = "activation_flat identity_map profiles font_style"
USAGE_VIEWS = f"{ENRICH_VIEWS} font usage_types source_systems identifier_types"
