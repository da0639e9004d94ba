"""Registry of queries and of the SQL that states their expected result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def check(name: str, oracle: str | None = None, doubles: tuple[str, ...] = ()):
    """Register a query; ``oracle`` is the SQL over the same tables.

    ``doubles`` are integer columns with NULLs. They are compared as doubles, which hold
    these values exactly, because data-frame libraries disagree about a missing integer.
    """

    def add(function: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = plain(function(prepare(spark), sf_dir))
            return df.withColumns({c: F.col(c).cast("double") for c in doubles}) if doubles else df

        run.__name__ = name
        run.__doc__ = function.__doc__
        QUERIES[name] = run
        if oracle is not None:
            casts = ", ".join(f"CAST({c} AS DOUBLE) AS {c}" for c in doubles)
            ORACLES[name] = f"SELECT * REPLACE ({casts}) FROM ({oracle})" if doubles else oracle
        return function

    return add


def plain(df: DataFrame) -> DataFrame:
    """Types that compare alike on every engine: dates as text, times as microseconds,
    decimals as doubles, integers as bigint."""
    outputs = []
    for field in df.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, T.DateType):
            column = column.cast("string")
        elif isinstance(field.dataType, (T.TimestampType, T.TimestampNTZType)):
            column = F.unix_micros(column)
        elif isinstance(field.dataType, T.DecimalType):
            column = column.cast("double")
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            column = column.cast("bigint")
        outputs.append(column.alias(field.name))
    return df.select(*outputs)
