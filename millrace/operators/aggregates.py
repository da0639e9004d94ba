"""Group-by steps. Every one is a partial plus final aggregate: copies of a hot key meet
on the map side, and only one row per key and task is shuffled."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cases import condition
from millrace.functions.times import seconds_between
from millrace.operators import windows
from millrace.session import materialize


def first_present(column: str, order_by: Sequence[str]) -> Column:
    """(order, value) of a row that has a value; NULL otherwise."""
    row = F.struct(*order_by, F.col(column).alias("__value"))
    return F.when(F.col(column).isNotNull(), row)


def first_value(column: str, order_by: Sequence[str]) -> Column:
    """The first non-NULL value of ``column`` by ``order_by``, as pandas ``first`` means it."""
    return F.min(first_present(column, order_by)).getField("__value").alias(column)


def aggregate(
    df: DataFrame,
    group_by: Sequence[str],
    metrics: Mapping[str, str | Column],
    keep_first: Sequence[str] = (),
    order_by: Sequence[str] = (),
) -> DataFrame:
    """Metrics as Spark SQL aggregate text; ``keep_first`` columns need an order."""
    if keep_first and not order_by:
        raise ValueError("keep_first has no meaning without order_by")
    outputs = [condition(m).alias(name) for name, m in metrics.items()]
    outputs += [first_value(c, order_by) for c in keep_first]
    return df.groupBy(*group_by).agg(*outputs)


def exact_sum(column: str, scale: int = 2) -> Column:
    """Sum of money in decimal arithmetic, rounded once at the end: the result does not depend
    on the order of rows, and small amounts add up."""
    return F.round(F.sum(F.col(column).cast("decimal(38,10)")), scale)


def exact_mean(column: str, scale: int = 2) -> Column:
    return exact_sum(column, scale).cast("double") / F.count(column)


def count_rows(
    df: DataFrame, group_by: Sequence[str], output: str, weight: str | None = None
) -> DataFrame:
    """Rows per group. ``weight`` sums the counts of an earlier roll-up instead."""
    total = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.groupBy(*group_by).agg(total.cast("bigint").alias(output))


def first_rows(
    df: DataFrame,
    deduplicate_by: Sequence[str],
    order_by: Sequence[str],
    columns: Sequence[str],
) -> DataFrame:
    """The first row per key, projected to ``columns``."""
    needed = list(dict.fromkeys([*deduplicate_by, *order_by, *columns]))
    return windows.deduplicate(
        df.select(*needed), deduplicate_by, order_by, keep="first"
    ).select(*columns)


def collapse(
    df: DataFrame,
    key: Sequence[str],
    order_by: Sequence[str],
    minimum: Sequence[str],
    keep_first: Sequence[str],
) -> DataFrame:
    """One row per key: the minimum of some columns, the first non-NULL of others."""
    return df.groupBy(*key).agg(
        *[F.min(c).alias(c) for c in minimum],
        *[first_value(c, order_by) for c in keep_first],
    )


def session_metrics(
    events: DataFrame,
    user: str,
    timestamp: str,
    page: str,
    keep_first: Sequence[str],
    order_by: Sequence[str],
    inactivity_gap_minutes: float = 30,
    session: str = "session_id",
) -> DataFrame:
    """Sessions and their metrics without ever ordering or joining the raw rows.

    Rows are first reduced to one per (user, slot, page), sessions are numbered over the
    slots (see ``windows.sessionize``), and the reduced rows are rolled up: page views, the
    duration in seconds, the exact number of distinct pages and the first values. However
    the rows of a hot user are spread over pages, no task holds them all. Rows without a time
    belong to no session; ``count_untimed`` counts them.
    """
    firsts = {c: f"__first_{c}" for c in keep_first}
    slotted = events.where(F.col(timestamp).isNotNull()).withColumn(
        "__slot", windows.time_slot(timestamp, inactivity_gap_minutes)
    )
    reduced = slotted.groupBy(user, "__slot", page).agg(
        F.count(page).alias("__views"),
        F.min(timestamp).alias("__min"),
        F.max(timestamp).alias("__max"),
        *[F.min(first_present(c, order_by)).alias(name) for c, name in firsts.items()],
    )
    # Written, as both the slots and the metrics come from it: the events are read once.
    reduced = materialize(reduced, "slots")
    bounds = reduced.groupBy(user, "__slot").agg(
        F.min("__min").alias("__slot_min"), F.max("__max").alias("__slot_max")
    )
    numbered = windows.session_slots(
        bounds, user, "__slot", "__slot_min", "__slot_max", inactivity_gap_minutes, session
    ).select(F.col(user).alias("__key"), F.col("__slot").alias("__key_slot"), session)
    return (
        reduced.join(
            numbered,
            F.col(user).eqNullSafe(F.col("__key")) & (F.col("__slot") == F.col("__key_slot")),
        )
        .groupBy(user, session)
        .agg(
            F.sum("__views").alias("page_views"),
            seconds_between(F.min("__min"), F.max("__max")).alias("session_duration_sec"),
            F.count_distinct(page).alias("unique_pages"),
            *[F.min(name).getField("__value").alias(c) for c, name in firsts.items()],
        )
    )


def count_untimed(events: DataFrame, timestamp: str) -> DataFrame:
    """How many rows sessions leave out because they have no time."""
    return events.agg(F.count_if(F.col(timestamp).isNull()).alias("untimed"))


def monthly_rollup(
    existing: DataFrame,
    new: DataFrame,
    group_by: Sequence[str],
    first_column: str,
    months: DataFrame | Column,
    latest: Sequence[str] = (),
) -> DataFrame:
    """Existing rows of the impacted months plus the new rows, rolled up again.

    ``months`` is the predicate (or a frame of year and month) that selects the impacted
    months of ``existing``; a predicate prunes partitions at planning time. ``latest`` columns,
    such as a modification time, take their maximum.
    """
    if isinstance(months, DataFrame):
        touched = existing.join(months, ["year", "month"], "left_semi")
    else:
        touched = existing.where(months)
    columns = [*group_by, "first_usage", "last_usage", "usage_count", first_column, *latest]
    both = touched.select(*columns, F.lit(0).alias("__age")).unionByName(
        new.select(*columns, F.lit(1).alias("__age"))
    )
    return both.groupBy(*group_by).agg(
        F.min("first_usage").alias("first_usage"),
        F.max("last_usage").alias("last_usage"),
        F.sum("usage_count").cast("bigint").alias("usage_count"),
        first_value(first_column, ["__age", "first_usage", first_column]),
        *[F.max(c).alias(c) for c in latest],
    )
