"""Routing rows to several destinations."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.functions.cases import holds


def split_routing(
    df: DataFrame,
    condition: str | Column,
    when_true: str,
    when_false: str,
    output_column: str = "route",
) -> DataFrame:
    """Name the route of every row; a NULL condition takes the false route."""
    return df.withColumn(
        output_column, F.when(holds(condition), when_true).otherwise(when_false)
    )


def routes(df: DataFrame, names: Mapping[str, str], column: str = "route") -> dict[str, DataFrame]:
    """One frame per route. Give a materialized ``df``, so that it is computed once."""
    return {key: df.where(F.col(column) == value).drop(column) for key, value in names.items()}
