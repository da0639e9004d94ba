"""Sessions over micro-batches, with their open part as a table of slots.

A batch is reduced to one row for each (user, gap-wide slot, distinct value) and merged with the rows that
are still open. Two rows of a slot are always in one session, so only slots are ordered; a
session is rolled up when it closes. The state of a user who sends a third of all rows is one row
for each open slot and value, spread over tasks, and not a set or list in one of them.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from millrace.functions.times import seconds_between
from millrace.operators.aggregates import first_present
from millrace.operators.windows import time_slot

_METRIC = re.compile(r"\s*(count|sum|min|max|count_distinct)\(\s*(distinct\s+)?(\*|1|\w+)\s*\)\s*", re.IGNORECASE)
_RANGE = re.compile(r"\s*max\(\s*(\w+)\s*\)\s*-\s*min\(\s*(\w+)\s*\)\s*", re.IGNORECASE)
SLOT, FIRST_TIME, LAST_TIME = "__slot", "__first_time", "__last_time"


@dataclass(frozen=True)
class Sessions:
    """Sessions of ``user`` by ``timestamp``. ``session`` names the output column, which holds the start in
    microseconds; with ``keep_first``, ``order_by`` says which value is the first (ties: the least one).

    Metrics are ``count(c)``, ``sum(c)``, ``min(c)``, ``max(c)``, ``max(time) - min(time)`` in seconds, and
    ``count_distinct(c)`` of one column.
    """

    user: str
    timestamp: str
    metrics: Mapping[str, str]
    gap_minutes: float = 30
    session: str = "session_id"
    keep_first: Sequence[str] = ()
    order_by: Sequence[str] = ()

    def parsed(self) -> dict[str, tuple[str, str]]:
        """(kind, column) of each metric."""
        found = {}
        for name, text in self.metrics.items():
            if both := _RANGE.fullmatch(text):
                if {both[1], both[2]} != {self.timestamp}:
                    raise ValueError(f"metric {name}: only the range of {self.timestamp} is known")
                found[name] = ("range", self.timestamp)
            elif one := _METRIC.fullmatch(text):
                kind = "count_distinct" if one[2] else one[1].lower()
                found[name] = (kind, "1" if one[3] == "*" else one[3])
            else:
                raise ValueError(f"metric {name}: {text!r} cannot be kept over batches")
        if len({c for kind, c in found.values() if kind == "count_distinct"}) > 1:
            raise ValueError("distinct counts of one column only")
        return found

    def keys(self) -> list[str]:
        return [self.user, SLOT, *dict.fromkeys(c for kind, c in self.parsed().values() if kind == "count_distinct")]

    def _kept(self) -> dict[str, tuple[str, str]]:
        return {f"__m_{n}": (kind, c) for n, (kind, c) in self.parsed().items() if kind not in ("range", "count_distinct")}

    def reduce(self, events: DataFrame) -> DataFrame:
        """One row for each user, slot and distinct value. Rows without a time are left out."""
        value = {n: F.lit(1) if c == "1" else F.col(c) for n, (_, c) in self._kept().items()}
        how = {"count": F.count, "sum": F.sum, "min": F.min, "max": F.max}
        order = list(self.order_by) or [self.timestamp]
        return (
            events.where(F.col(self.timestamp).isNotNull())
            .withColumn(SLOT, time_slot(self.timestamp, self.gap_minutes))
            .groupBy(*self.keys())
            .agg(
                F.min(self.timestamp).alias(FIRST_TIME),
                F.max(self.timestamp).alias(LAST_TIME),
                *[how[kind](value[n]).alias(n) for n, (kind, _) in self._kept().items()],
                *[F.min(first_present(c, order)).alias(f"__f_{c}") for c in self.keep_first],
            )
        )

    def _merged(self) -> list[Column]:
        how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        return [
            F.min(FIRST_TIME).alias(FIRST_TIME),
            F.max(LAST_TIME).alias(LAST_TIME),
            *[how[kind](n).alias(n) for n, (kind, _) in self._kept().items()],
            *[F.min(f"__f_{c}").alias(f"__f_{c}") for c in self.keep_first],
        ]

    def merge(self, open_rows: DataFrame, new: DataFrame) -> DataFrame:
        return open_rows.unionByName(new).groupBy(*self.keys()).agg(*self._merged())

    def placed(self, rows: DataFrame, watermark: Column) -> DataFrame:
        """``rows`` (a written frame: it is read twice) with ``__begin``, and ``__closed`` where no row at or after
        ``watermark`` (microseconds) can belong to the session any more."""
        gap = int(self.gap_minutes * 60_000_000)
        slots = rows.groupBy(self.user, SLOT).agg(
            F.unix_micros(F.min(FIRST_TIME)).alias("__lo"), F.unix_micros(F.max(LAST_TIME)).alias("__hi")
        )
        ordered = Window.partitionBy(self.user).orderBy(SLOT)
        last = F.lag("__hi").over(ordered)
        begins = F.when(last.isNull() | (F.col("__lo") - last > gap), F.col("__lo"))
        slots = slots.withColumn("__begins", begins).withColumn(
            "__begin", F.last("__begins", ignorenulls=True).over(ordered.rowsBetween(Window.unboundedPreceding, 0))
        )
        ends = F.max("__hi").over(Window.partitionBy(self.user, "__begin"))
        slots = slots.withColumn("__closed", F.coalesce(ends + gap < watermark, F.lit(False)))
        slots = slots.select(F.col(self.user).alias("__user"), F.col(SLOT).alias("__at"), "__begin", "__closed")
        same = F.col(self.user).eqNullSafe(F.col("__user")) & (F.col(SLOT) == F.col("__at"))
        return rows.join(slots, same).drop("__user", "__at")

    def rolled_up(self, placed: DataFrame) -> DataFrame:
        """One row for each session."""
        how = {"count": F.sum, "sum": F.sum, "min": F.min, "max": F.max}
        outputs = []
        for name, (kind, column) in self.parsed().items():
            if kind == "range":
                one = seconds_between(F.min(FIRST_TIME), F.max(LAST_TIME))
            elif kind == "count_distinct":
                one = F.count_distinct(column)
            else:
                one = how[kind](f"__m_{name}")
            outputs.append(one.alias(name))
        firsts = [F.min(f"__f_{c}").getField("__value").alias(c) for c in self.keep_first]
        return placed.groupBy(self.user, F.col("__begin").alias(self.session)).agg(*outputs, *firsts)
