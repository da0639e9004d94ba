"""User activity: clicks to session metrics, batch and streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from millrace.operators import aggregates, enrich, filters
from millrace.sources.lookups import snapshot
from millrace.streaming import sessions

# Declared fields of the click stream and the inactivity gap.
CLICK_SCHEMA = T.StructType(
    [
        T.StructField("event_id", T.LongType()),
        T.StructField("user_id", T.LongType()),
        T.StructField("event_type", T.StringType()),
        T.StructField("page_url", T.StringType()),
        T.StructField("timestamp", T.TimestampType()),
        T.StructField("device_type", T.StringType()),
        T.StructField("referrer", T.StringType()),
    ]
)
INACTIVITY_GAP_MINUTES = 30
PROFILE_FIELDS = ("account_type", "signup_date", "country")


def user_sessions(
    clicks: DataFrame, users: DataFrame, order_by: tuple[str, ...] = ("timestamp", "event_id")
) -> DataFrame:
    """Bots out, sessions rolled up, then the profile joined.

    A profile field has one value per user, so joining after the roll-up gives the same
    rows as joining every click, on a small fraction of them.
    """
    people = filters.exclude_value(clicks, "device_type", "bot")
    metrics = aggregates.session_metrics(
        people,
        "user_id",
        "timestamp",
        "page_url",
        ["device_type"],
        order_by,
        INACTIVITY_GAP_MINUTES,
    )
    return _with_profile(metrics, users)


def user_session_stream(
    clicks: DataFrame,
    users: DataFrame,
    order_by: tuple[str, ...] = ("timestamp", "event_id"),
    watermark: str = "10 minutes",
) -> DataFrame:
    """The same over a stream; a session is named by its start."""
    people = filters.exclude_value(clicks, "device_type", "bot")
    metrics = sessions.session_stream(
        people,
        "user_id",
        "timestamp",
        "page_url",
        ["device_type"],
        order_by,
        INACTIVITY_GAP_MINUTES,
        watermark,
    )
    return _with_profile(metrics, users)


def _with_profile(metrics: DataFrame, users: DataFrame) -> DataFrame:
    """Every declared profile field that the user table has, from one snapshot of it."""
    fields = [c for c in PROFILE_FIELDS if c in users.columns]
    profiles = snapshot(enrich.unique_lookup(users, ["user_id"], fields))
    return enrich.enrich(metrics, profiles, {"user_id": "user_id"}, {c: c for c in fields})
