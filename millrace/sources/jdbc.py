"""Database tables over JDBC. Spark pushes filters, column choice and LIMIT into the query."""

from __future__ import annotations

import math
import os
from collections.abc import Mapping
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

# Database kinds of a source description, with JDBC prefix and default port.
JDBC_KINDS = {
    "mysql": ("jdbc:mysql://{host}:{port}/{database}", 3306),
    "postgresql": ("jdbc:postgresql://{host}:{port}/{database}", 5432),
    "postgres": ("jdbc:postgresql://{host}:{port}/{database}", 5432),
    "mssql": ("jdbc:sqlserver://{host}:{port};databaseName={database}", 1433),
    "oracle": ("jdbc:oracle:thin:@//{host}:{port}/{database}", 1521),
    "sqlite": ("jdbc:sqlite:{database}", None),
}


def connection_options(connection: Mapping[str, Any]) -> dict[str, str]:
    """JDBC options from ``source`` (or ``engine``), host, port, username, database.

    The password is read from the environment variable named ``password_env_var``.
    """
    kind = connection.get("source") or connection.get("engine")
    if kind not in JDBC_KINDS:
        raise ValueError(f"unknown database kind {kind!r}; known: {', '.join(JDBC_KINDS)}")
    template, port = JDBC_KINDS[kind]
    options = {
        "url": template.format(
            host=connection.get("host", "localhost"),
            port=connection.get("port", port),
            database=connection["database"],
        )
    }
    if "username" in connection:
        options["user"] = connection["username"]
    if "password_env_var" in connection:
        options["password"] = os.environ[connection["password_env_var"]]
    if "jdbc_driver" in connection:
        options["driver"] = connection["jdbc_driver"]
    return options


def read_options(
    connection: Mapping[str, Any],
    partition_column: str | None = None,
    lower_bound: Any = None,
    upper_bound: Any = None,
    num_partitions: int | None = None,
    fetch_size: int = 10_000,
    execution_date: date | None = None,
) -> dict[str, str]:
    """Options of a table or query read; with a partition column it runs as parallel ranges.

    ``{{execution_date}}`` in a query becomes the ISO date; only a real date is taken, as
    JDBC reads bind no parameters.
    """
    options = connection_options(connection)
    options["fetchsize"] = str(fetch_size)
    if "query" in connection:
        query = connection["query"].strip()
        if execution_date is not None:
            query = query.replace("{{execution_date}}", date.isoformat(execution_date))
        if partition_column:
            options["dbtable"] = f"({query}) source_query"
        else:
            options["query"] = query
    else:
        options["dbtable"] = connection["table"]
    if partition_column:
        options.update(
            partitionColumn=partition_column,
            lowerBound=str(lower_bound),
            upperBound=str(upper_bound),
            numPartitions=str(num_partitions),
        )
    return options


# Rows that one range of a partitioned read is meant to hold.
ROWS_PER_PARTITION = 1_000_000


def bounds_query(options: Mapping[str, str], column: str) -> str:
    """The query for the extent of ``column``, in one row: low, high and the number of rows."""
    return f"SELECT MIN({column}) AS low, MAX({column}) AS high, COUNT(*) AS n FROM {options['dbtable']}"


def ranges(low: Any, high: Any, n: int, rows_per_partition: int = ROWS_PER_PARTITION) -> dict[str, Any]:
    """Bounds and number of the ranges of a read, from the extent of a numeric, date or time column.

    None for a table without values in the column, or small enough for one task. No row is lost outside the bounds:
    Spark's first and last range are open, and NULL is in the first. Skewed values give uneven ranges.
    """
    count = -(-int(n) // rows_per_partition)
    if low is None or high is None or count < 2:
        return {}
    if isinstance(low, datetime):
        low, high = (v.strftime("%Y-%m-%d %H:%M:%S.%f") for v in (low, high))
    elif isinstance(low, date):
        low, high = low.isoformat(), high.isoformat()
    elif isinstance(low, (int, float, Decimal)) and not isinstance(low, bool):
        low, high = math.floor(low), math.ceil(high)  # bounds are whole numbers
    else:
        raise ValueError(f"a {type(low).__name__} column gives no ranges: take a number, date or time")
    if low == high:
        return {}
    return {"lower_bound": low, "upper_bound": high, "num_partitions": count}


def read_table(
    spark: SparkSession,
    connection: Mapping[str, Any],
    partition_column: str | None = None,
    rows_per_partition: int = ROWS_PER_PARTITION,
    **options,
) -> DataFrame:
    """Full load of a table (or query). A limit on the result becomes LIMIT in the source.

    With a partition column but no bounds, one query asks the database for the column's extent and row count, and
    the read is cut into ranges of about ``rows_per_partition`` rows.
    """
    if partition_column and "num_partitions" not in options:
        whole = read_options(connection, partition_column, 0, 1, 1, **options)
        asked = {k: v for k, v in whole.items() if k not in ("dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")}
        extent = _load(spark, {**asked, "query": bounds_query(whole, partition_column)}).first()
        found = ranges(*extent, rows_per_partition)
        partition_column = partition_column if found else None
        options |= found
    return _load(spark, read_options(connection, partition_column, **options))


def _load(spark: SparkSession, options: Mapping[str, str]) -> DataFrame:
    return spark.read.format("jdbc").options(**options).load()
