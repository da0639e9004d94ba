"""Activation events: nested images to download counts, project assets and monthly usage."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.images import RECORD_PATH, any_list_filled
from millrace.operators import aggregates, columns, enrich, quality, routing
from millrace.session import materialize_all
from millrace.sources.lookups import lookup

# Fixed values below: event types, packed-field positions, keys and columns of the results.
EVENT_TYPES = (
    "permanentActivation",
    "temporaryActivation",
    "riskScan",
    "autoActivation",
    "addedToLibrary",
)
PACKED_DELIMITER = ":XTS:"
PACKED_FIELDS = {"ps_name": 0, "fontsense_id": 5, "style_id": 6}
PROJECT_ROUTE, DOWNLOAD_ROUTE = "webproject_path", "sync_download_path"
PROJECT_CONDITION = "event_type = 'addedToLibrary' AND project_type = 'WebProject' AND project_id IS NOT NULL"
SOURCE_SYSTEM, IDENTIFIER_TYPE = "Connect", "GCID"

MISSING_FIELD, WRONG_TYPE, NO_FONTS = "required_fields", "event_type", "font_list"
NO_CUSTOMER, NO_STYLE, NO_PROFILE, NO_USAGE = "gcid", "font_style", "profile", "usage"
RECORD_REASONS = (MISSING_FIELD, WRONG_TYPE, NO_FONTS)

DOWNLOAD_KEYS = (
    "gcid",
    "profile_id",
    "font_style_id",
    "family_id",
    "event_type",
    "event_date",
)
DOWNLOAD_CONSTANTS = {"source": "NA", "subtype": "NA"}
ASSET_KEYS = ("project_id", "font_style_id", "created_at")
ASSET_COLUMNS = (
    "asset_type",
    "project_id",
    "profile_id",
    "gcid",
    "font_style_id",
    "family_id",
    "created_at",
    "is_deleted",
    "asset_deleted_at",
)
PROJECT_FIRST = ("profile_id", "gcid", "project_name", "project_type", "is_deleted")
USAGE_KEYS = (
    "customer_id",
    "font_id",
    "usage_type_id",
    "source_system_id",
    "customer_identifier_type_id",
    "event_date",
)
MERGE_KEYS = ("customer_id", "font_id", "year", "month", "usage_type", "source_system")


def parse_records(images: DataFrame) -> DataFrame:
    """Flat records with the reason, if any, to skip the whole record."""
    filled = any_list_filled(RECORD_PATH)
    parsed = columns.parse_image(images.withColumn("has_fonts", filled))
    return quality.mark_rejects(
        parsed,
        [
            (MISSING_FIELD, quality.complete(["mtf_id", "user", "timestamp", "event_type"])),
            (WRONG_TYPE, F.col("event_type").isin(list(EVENT_TYPES))),
            (NO_FONTS, F.col("has_fonts")),
        ],
    ).drop("has_fonts")


def font_entries(records: DataFrame) -> DataFrame:
    """One row per font entry of the good records, identifiers parsed, route named."""
    entries = columns.explode_fonts(quality.valid_rows(records))
    parsed = columns.parse_packed(entries, "font_entry", PACKED_DELIMITER, PACKED_FIELDS)
    typed = columns.cast_types(parsed, {"fontsense_id": "bigint"}, errors="coerce")
    dated = columns.event_dates(typed)
    return routing.split_routing(dated, PROJECT_CONDITION, PROJECT_ROUTE, DOWNLOAD_ROUTE).drop(
        "font_entry"
    )


def count_entries(entries: DataFrame) -> DataFrame:
    """Entries counted by every field the lookups or the final counts need.

    This runs before any lookup join: a hot user or font, however many rows it has, goes
    into the joins as one row per day and event type.
    """
    keys = [
        "mtf_id",
        "user",
        "event_type",
        "event_date",
        "year",
        "month",
        "fontsense_id",
        "ps_name",
        "route",
    ]
    return aggregates.count_rows(entries, keys, "entries")


def prepare_lookups(raw: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """Each raw lookup table reduced to one row per key and written once for the run."""
    reduced = {
        "customers": lookup(raw["customers"], ["identity_provider_id"], ["customer_id"]),
        "profiles": lookup(raw["profiles"], ["email", "customer_id"], ["profile_id"]),
        "styles": enrich.either_key(
            raw["styles"], ["font_style_id", "pimid"], ["font_style_id", "family_id"]
        ),
        "fonts_by_id": lookup(raw["fonts"], ["fontsense_id"], ["font_id"]),
        "fonts_by_name": lookup(raw["fonts"], ["ps_name"], ["font_id"]),
        "usage_types": lookup(raw["usage_types"], ["name"], ["id"]),
        "source_systems": lookup(raw["source_systems"], ["name"], ["id"]),
        "identifier_types": lookup(raw["identifier_types"], ["name"], ["id"]),
    }
    return materialize_all(reduced)


def enrich_entries(entries: DataFrame, lookups: Mapping[str, DataFrame]) -> DataFrame:
    """Customer, profile and style. Every row stays; a miss sets ``reject_reason``.

    ``lookups`` are prepared ones. A profile miss rejects only on the download route.
    """
    with_customer = enrich.enrich(
        entries,
        lookups["customers"],
        {"mtf_id": "identity_provider_id"},
        {"gcid": "customer_id"},
    )
    with_profile = enrich.enrich(
        with_customer,
        lookups["profiles"],
        {"user": "email", "gcid": "customer_id"},
        {"profile_id": "profile_id"},
    )
    with_style = enrich.enrich(
        with_profile,
        lookups["styles"],
        {"fontsense_id": "lookup_key"},
        {"font_style_id": "font_style_id", "family_id": "family_id"},
    )
    return quality.mark_rejects(
        with_style,
        [
            (NO_CUSTOMER, F.col("gcid").isNotNull()),
            (NO_STYLE, F.col("font_style_id").isNotNull()),
            (
                NO_PROFILE,
                F.col("profile_id").isNotNull() | (F.col("route") == PROJECT_ROUTE),
            ),
        ],
    )


def sync_download(enriched: DataFrame, load_date: date, weight: str | None = None) -> DataFrame:
    """Counts of the download route with the constant columns."""
    good = quality.valid_rows(enriched).where(F.col("route") == DOWNLOAD_ROUTE)
    counted = aggregates.count_rows(good, DOWNLOAD_KEYS, "event_count", weight)
    return columns.static_columns(counted, {**DOWNLOAD_CONSTANTS, "load_date": load_date})


def project_rows(enriched: DataFrame) -> DataFrame:
    """Rows of the project route with the asset columns."""
    good = quality.valid_rows(enriched).where(F.col("route") == PROJECT_ROUTE)
    return good.withColumnRenamed("timestamp", "created_at").withColumns(
        {"is_deleted": F.lit(False), "asset_deleted_at": F.lit(None).cast("timestamp")}
    )


def assets(projects: DataFrame) -> DataFrame:
    """The first row per project, style and time."""
    return aggregates.first_rows(projects, ASSET_KEYS, ["event_id"], ASSET_COLUMNS)


def project_summary(projects: DataFrame) -> DataFrame:
    """One row per project with the target's column names."""
    collapsed = aggregates.collapse(
        projects, ["project_id"], ["created_at", "event_id"], ["created_at"], PROJECT_FIRST
    )
    return collapsed.select(
        F.col("project_id").alias("id"),
        F.col("project_name").alias("name"),
        "project_type",
        "profile_id",
        "gcid",
        "created_at",
        "is_deleted",
        F.lit(None).cast("timestamp").alias("project_deleted_at"),
    )


def enrich_usage(enriched: DataFrame, lookups: Mapping[str, DataFrame]) -> DataFrame:
    """Usage fields; a row without one of them is skipped for usage only.

    A missing profile does not matter to usage, so that reason is lifted first.
    """
    base = enriched.withColumn(
        "reject_reason",
        F.when(F.col("reject_reason") != NO_PROFILE, F.col("reject_reason")),
    )
    with_font = enrich.enrich_fallback_key(
        base,
        [
            ("fontsense_id", lookups["fonts_by_id"], "fontsense_id"),
            ("ps_name", lookups["fonts_by_name"], "ps_name"),
        ],
        {"font_id": "font_id"},
    )
    with_ids = enrich_type_ids(with_font.withColumn("customer_id", F.col("gcid")), lookups)
    required = ["customer_id", "font_id", "usage_type_id", "source_system_id", "event_date"]
    return quality.mark_rejects(with_ids, [(NO_USAGE, quality.complete(required))])


def enrich_type_ids(df: DataFrame, lookups: Mapping[str, DataFrame]) -> DataFrame:
    """Type names to ids: the usage type of each row by a join; the source system and the
    identifier type, which are constants of the pipeline, as scalar subqueries."""
    with_type = enrich.enrich(
        df, lookups["usage_types"], {"event_type": "name"}, {"usage_type_id": "id"}
    )
    return with_type.withColumns(
        {
            "source_system_id": enrich.single_value(
                lookups["source_systems"], "name", SOURCE_SYSTEM, "id"
            ),
            "customer_identifier_type_id": enrich.single_value(
                lookups["identifier_types"], "name", IDENTIFIER_TYPE, "id"
            ),
        }
    )


def daily_usage(usage: DataFrame, weight: str | None = None) -> DataFrame:
    """Usage counts per day."""
    good = quality.valid_rows(usage)
    return aggregates.count_rows(good, USAGE_KEYS, "fu_event_count", weight)


def monthly_usage(usage: DataFrame, weight: str | None = None) -> DataFrame:
    """New usage in the shape of the monthly target."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return (
        quality.valid_rows(usage)
        .withColumnRenamed("event_type", "usage_type")
        .groupBy("customer_id", "font_id", "year", "month", "usage_type")
        .agg(
            F.min("event_date").alias("first_usage"),
            F.max("event_date").alias("last_usage"),
            total.cast("bigint").alias("usage_count"),
        )
        .withColumns(
            {
                "source_system": F.lit(SOURCE_SYSTEM),
                "customer_identifier_type": F.lit(IDENTIFIER_TYPE),
            }
        )
    )
