"""Sessions over a stream."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.functions.times import seconds_between
from millrace.operators.aggregates import first_value


def session_stream(
    events: DataFrame,
    user: str,
    timestamp: str,
    page: str,
    keep_first: Sequence[str] = (),
    order_by: Sequence[str] = (),
    inactivity_gap_minutes: int = 30,
    watermark: str = "10 minutes",
) -> DataFrame:
    """Session metrics from Spark's own session state; also runs on a batch frame.

    Rows later than ``watermark`` are dropped, which the query progress counts. Distinct pages
    are an exact set per open session (a stream takes no distinct count): its size is the
    number of different pages one user opens in one session, not of rows. The session
    setting ``...sessionWindow.merge.sessions.in.local.partition`` merges a hot user's rows on
    the map side first.
    """
    source = events.withWatermark(timestamp, watermark) if events.isStreaming else events
    window = F.session_window(timestamp, f"{inactivity_gap_minutes} minutes")
    grouped = source.groupBy(user, window.alias("session")).agg(
        F.count(page).alias("page_views"),
        F.min(timestamp).alias("__first"),
        F.max(timestamp).alias("__last"),
        F.size(F.collect_set(page)).cast("bigint").alias("unique_pages"),
        *[first_value(c, order_by) for c in keep_first],
    )
    return grouped.select(
        user,
        F.col("session.start").alias("session_start"),
        "page_views",
        seconds_between(F.col("__first"), F.col("__last")).alias("session_duration_sec"),
        "unique_pages",
        *keep_first,
    )
