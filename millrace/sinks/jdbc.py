"""Database targets over JDBC."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame

from millrace.sources.jdbc import connection_options


def write_options(destination: Mapping[str, Any]) -> dict[str, str]:
    """Options of a write: the chunk size bounds one INSERT batch, ``connections`` the tasks."""
    options = connection_options(destination)
    options["dbtable"] = destination["table"]
    options["batchsize"] = str(destination.get("chunksize", destination.get("batch_size", 1000)))
    if "connections" in destination:
        options["numPartitions"] = str(destination["connections"])
    if "column_types" in destination:
        options["createTableColumnTypes"] = destination["column_types"]
    if destination.get("mode") == "replace" and destination.get("keep_ddl"):
        options["truncate"] = "true"
    return options


def write_table(df: DataFrame, destination: Mapping[str, Any]) -> None:
    """Modes ``append`` and ``replace``. The keyed modes need the database's own MERGE: append
    to a staging table here and merge there, or use ``sinks.tables``."""
    modes = {"append": "append", "replace": "overwrite"}
    mode = destination.get("mode", "append")
    if mode not in modes:
        raise ValueError(f"mode {mode} over JDBC: write a staging table and merge it there")
    df.write.format("jdbc").options(**write_options(destination)).mode(modes[mode]).save()
