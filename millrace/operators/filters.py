"""Row filters. Each states what a NULL does."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cases import condition


def filter_rows(df: DataFrame, condition_: str | Column) -> DataFrame:
    """Keep rows where the condition is true (plain SQL: NULL drops the row)."""
    return df.where(condition(condition_))


def exclude_value(df: DataFrame, column: str, value: Any) -> DataFrame:
    """``column != value`` as pandas means it: a NULL differs and is kept.

    The null-safe form still reaches the parquet scan as a pushed filter.
    """
    return df.where(~F.col(column).eqNullSafe(F.lit(value)))


def keep_values(df: DataFrame, column: str, allowed: Sequence[Any]) -> DataFrame:
    """Allow-list; NULL is not on it."""
    return df.where(F.col(column).isin(list(allowed)))


def drop_incomplete(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Keep rows without a NULL in ``columns``."""
    return df.dropna(how="any", subset=list(columns))
