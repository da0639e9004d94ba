"""De-duplication, sessions and ordering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _orderable(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    skip = (T.MapType, T.VariantType)
    return [
        f.name for f in df.schema if f.name not in exclude and not isinstance(f.dataType, skip)
    ]


def deduplicate(
    df: DataFrame,
    subset: Sequence[str],
    order_by: Sequence[str] | str,
    keep: str = "last",
    tiebreak: Sequence[str] | None = None,
) -> DataFrame:
    """One row per ``subset``; NULL keys equal each other.

    ``keep="last"`` takes the greatest by ``order_by``, ``"first"`` the least; a NULL in the
    order loses either way. Ties go on to ``tiebreak``, by default all other columns, so
    the survivor never depends on arrival order. Spark limits every key to one row per
    input partition before the shuffle (WindowGroupLimit), so a hot key stays small.
    """
    order = [order_by] if isinstance(order_by, str) else list(order_by)
    if keep not in ("first", "last"):
        raise ValueError(f"keep must be first or last, not {keep}")
    ties = _orderable(df, [*subset, *order]) if tiebreak is None else list(tiebreak)
    direction = "desc_nulls_last" if keep == "last" else "asc_nulls_last"
    keys = [getattr(F.col(c), direction)() for c in [*order, *ties]]
    window = Window.partitionBy(*subset).orderBy(*keys)
    return df.withColumn("__rn", F.row_number().over(window)).where("__rn = 1").drop("__rn")


def deduplicate_any(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """One row per ``columns``, whichever."""
    return df.dropDuplicates(list(columns))


def time_slot(order_by: str, gap_minutes: float) -> Column:
    """Start, in microseconds, of the gap-wide slot a time falls in."""
    micros = F.unix_micros(F.col(order_by))
    return micros - F.pmod(micros, F.lit(int(gap_minutes * 60_000_000)))


def session_slots(
    slots: DataFrame,
    partition_by: str,
    slot: str,
    slot_min: str,
    slot_max: str,
    gap_minutes: float,
    output_column: str,
) -> DataFrame:
    """Number the sessions over per-slot time bounds, from 1 per ``partition_by`` value."""
    gap = int(gap_minutes * 60_000_000)
    ordered = Window.partitionBy(partition_by).orderBy(slot)
    previous = F.lag(F.unix_micros(slot_max)).over(ordered)
    starts = F.when(
        previous.isNull() | (F.unix_micros(slot_min) - previous > gap), F.lit(1)
    ).otherwise(F.lit(0))
    running = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return slots.withColumn("__start", starts).withColumn(
        output_column, F.sum("__start").over(running).cast("bigint")
    ).drop("__start")


def sessionize(
    df: DataFrame,
    partition_by: str,
    order_by: str,
    inactivity_gap_minutes: float = 30,
    output_column: str = "session_id",
) -> DataFrame:
    """Number sessions per ``partition_by``; a gap greater than the limit starts a new one.

    Two rows of one gap-wide slot are always closer than the gap, so a session can only
    break between slots. Rows are therefore reduced to one time range per (key, slot)
    before anything is ordered: however hot a key is, its window holds one row per slot of
    elapsed time. The numbers are then joined back to the rows. Rows without a time get
    a NULL session.
    """
    slotted = df.withColumn("__slot", time_slot(order_by, inactivity_gap_minutes))
    bounds = (
        slotted.where(F.col("__slot").isNotNull())
        .groupBy(partition_by, "__slot")
        .agg(F.min(order_by).alias("__min"), F.max(order_by).alias("__max"))
    )
    numbered = session_slots(
        bounds, partition_by, "__slot", "__min", "__max", inactivity_gap_minutes, output_column
    ).select(
        F.col(partition_by).alias("__key"), F.col("__slot").alias("__key_slot"), output_column
    )
    joined = slotted.drop(output_column).join(
        numbered,
        F.col(partition_by).eqNullSafe(F.col("__key"))
        & (F.col("__slot") == F.col("__key_slot")),
        "left",
    )
    return joined.drop("__slot", "__key", "__key_slot")


def sort_rows(
    df: DataFrame,
    by: Sequence[str],
    ascending: Sequence[bool] | bool = True,
    tiebreak: Sequence[str] = (),
) -> DataFrame:
    """Global sort, NULLs last in either direction.

    ``tiebreak`` columns make the order total; they also let the range partitioner split
    a run of equal sort keys over several tasks.
    """
    flags = [ascending] * len(by) if isinstance(ascending, bool) else list(ascending)
    if len(flags) != len(by):
        raise ValueError("one direction per sort key")
    keys = [
        F.col(c).asc_nulls_last() if up else F.col(c).desc_nulls_last()
        for c, up in zip(by, flags)
    ]
    return df.orderBy(*keys, *[F.col(c).asc_nulls_last() for c in tiebreak])


def row_limit(
    df: DataFrame, limit: int, order_by: Sequence[str] = ()
) -> DataFrame:
    """The first ``limit`` rows; with an order, a top-k that never sorts the whole table."""
    if limit < 1:
        raise ValueError("row_limit must be a positive integer")
    return (df.orderBy(*order_by) if order_by else df).limit(limit)
