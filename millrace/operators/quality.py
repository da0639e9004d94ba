"""Quality checks: a report in one pass, a failing mode and a row-skipping mode."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cases import holds
from millrace.session import materialize


class QualityError(ValueError):
    """A check failed; the message names every failing check."""


@dataclass(frozen=True)
class Check:
    """``kind`` is ``rows`` (violations counted per row), ``count``, ``unique`` or ``unique_wide``."""

    name: str
    target: str
    kind: str
    ok: Column | None = None
    columns: tuple[str, ...] = ()
    minimum: int = 0


def row_count_gt(threshold: int = 0) -> list[Check]:
    """Fails when the frame has ``threshold`` rows or fewer; its violation count is 0 or 1."""
    return [Check("row_count_gt", "*", "count", minimum=threshold)]


def not_null(columns: Sequence[str], name: str = "column_not_null") -> list[Check]:
    return [Check(name, c, "rows", F.col(c).isNotNull(), (c,)) for c in columns]


def required_fields(columns: Sequence[str]) -> list[Check]:
    return not_null(columns, "required_fields_not_null")


def value_range(column: str, minimum: Any, maximum: Any) -> list[Check]:
    """Inclusive; NULL is a violation."""
    ok = holds(F.col(column).between(minimum, maximum))
    return [Check("value_range", column, "rows", ok, (column,))]


def allowed_values(column: str, values: Sequence[Any]) -> list[Check]:
    """NULL is a violation."""
    ok = holds(F.col(column).isin(list(values)))
    return [Check("allowed_values", column, "rows", ok, (column,))]


def unique(columns: Sequence[str], wide: bool = False) -> list[Check]:
    """Violations are the rows beyond the first of each key; NULL keys equal each other.

    ``wide`` is for keys of long texts or many columns, of which few repeat: the same result in two
    phases, which exchange 64-bit hashes of all keys but only those keys whose hash is seen twice.
    """
    kind = "unique_wide" if wide else "unique"
    return [Check("unique_check", ",".join(columns), kind, columns=tuple(columns))]


def require_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fail at planning time when a column is missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise QualityError(f"missing columns: {', '.join(missing)}")
    return df


def report(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """One row per check: (check_name, target, violations, passed).

    All row checks and the row count share one aggregation without a shuffle of rows.
    Each uniqueness check adds a group-by on its key columns only; a wide one runs its first
    phase at once.
    """
    require_columns(df, [c for check in checks for c in check.columns])
    parts = []
    simple = [c for c in checks if not c.kind.startswith("unique")]
    if simple:
        counters = [
            (
                F.when(F.count(F.lit(1)) > c.minimum, 0).otherwise(1).cast("bigint")
                if c.kind == "count"
                else F.count_if(~c.ok)
            ).alias(f"v{i}")
            for i, c in enumerate(simple)
        ]
        lines = F.array(
            *[
                F.struct(
                    F.lit(c.name).alias("check_name"),
                    F.lit(c.target).alias("target"),
                    F.col(f"v{i}").alias("violations"),
                )
                for i, c in enumerate(simple)
            ]
        )
        parts.append(df.agg(*counters).select(F.inline(lines)))
    for c in checks:
        if c.kind.startswith("unique"):
            keys = _suspects(df, c.columns) if c.kind == "unique_wide" else df
            parts.append(
                keys.groupBy(*c.columns)
                .agg(F.count(F.lit(1)).alias("__n"))
                .agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("violations"))
                .select(
                    F.lit(c.name).alias("check_name"), F.lit(c.target).alias("target"), "violations"
                )
            )
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result.withColumn("passed", F.col("violations") == 0)


def _suspects(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The keys of rows whose key's hash another row has too: all repeated keys, and a few that only collide.

    The repeated hashes are written, so that their size is known when the join is planned: below the
    broadcast threshold the keys are filtered where they are read, and only the suspects are exchanged.
    """
    hashed = df.select(F.xxhash64(*columns).alias("__hash"))
    counts = hashed.groupBy("__hash").agg(F.count(F.lit(1)).alias("__n"))
    twice = materialize(counts.where("__n > 1").select("__hash"), "repeated")
    keys = df.select(*columns, F.xxhash64(*columns).alias("__hash"))
    return keys.join(twice, "__hash", "left_semi").drop("__hash")


def enforce(df: DataFrame, checks: Sequence[Check]) -> DataFrame:
    """Raise when a check fails, else return ``df``. Give a materialized frame: the checks
    read it once more. Only the report, one row per check, reaches the driver."""
    failed = report(df, checks).where(~F.col("passed")).collect()
    if failed:
        lines = [f"{r.check_name}({r.target}): {r.violations}" for r in failed]
        raise QualityError("quality checks failed: " + "; ".join(sorted(lines)))
    return df


def mark_rejects(
    df: DataFrame, rules: Sequence[tuple[str, str | Column]], column: str = "reject_reason"
) -> DataFrame:
    """Name the first broken rule of each row, NULL for a good row. A reason that an earlier
    step has set stays."""
    reason: Column | None = F.col(column) if column in df.columns else None
    for name, ok in rules:
        broken = F.when(~holds(ok), F.lit(name))
        reason = broken if reason is None else F.coalesce(reason, broken)
    return df.withColumn(column, reason)


def valid_rows(df: DataFrame, column: str = "reject_reason") -> DataFrame:
    return df.where(F.col(column).isNull()).drop(column)


def rejected_rows(df: DataFrame, column: str = "reject_reason") -> DataFrame:
    return df.where(F.col(column).isNotNull())


def complete(columns: Sequence[str]) -> Column:
    """Rule for ``mark_rejects``: no NULL in ``columns``."""
    ok = F.lit(True)
    for c in columns:
        ok = ok & F.col(c).isNotNull()
    return ok
