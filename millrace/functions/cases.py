"""Case expressions."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def condition(value: str | Column) -> Column:
    """A predicate given as a Column or as Spark SQL text."""
    return F.expr(value) if isinstance(value, str) else value


def first_match(cases: Sequence[tuple[str | Column, Any]], default: Any = None) -> Column:
    """The value of the first true condition; a NULL condition is not true."""
    result = None
    for when, then in cases:
        branch = (F.when if result is None else result.when)(condition(when), F.lit(then))
        result = branch
    return F.lit(default) if result is None else result.otherwise(F.lit(default))


def range_label(
    value: Column, buckets: Sequence[tuple[float | None, float | None, str]]
) -> Column:
    """The label of the first closed range ``[low, high]``; ``None`` leaves an end open."""
    cases = []
    for low, high, label in buckets:
        inside = value.isNotNull()
        if low is not None:
            inside = inside & (value >= low)
        if high is not None:
            inside = inside & (value <= high)
        cases.append((inside, label))
    return first_match(cases)


def holds(predicate: str | Column) -> Column:
    """The predicate with NULL counted as false."""
    return F.coalesce(condition(predicate), F.lit(False))
