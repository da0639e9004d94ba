"""A source from its description, as pipelines declare it."""

from __future__ import annotations

from collections.abc import Mapping
from datetime import date
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from millrace.operators.windows import row_limit
from millrace.sources import files, jdbc, manifests, streams


def open_source(
    spark: SparkSession,
    extract: Mapping[str, Any],
    schema: T.StructType | None = None,
    execution_date: date | None = None,
    control: DataFrame | None = None,
    job_name: str | None = None,
    keep_corrupt: bool = False,
) -> DataFrame:
    """The frame an ``extract`` mapping describes.

    ``source`` is a database kind, ``csv``, ``s3`` (``file_format`` csv or jsonl_gz), ``kafka``,
    ``json_files`` (a stream of JSON lines that arrive as files) or ``table`` (a catalog table). File and
    stream sources need ``schema``. A manifest feed with ``control`` reads only what is newer than the
    job's last successful run; ``days``, ``lookback_days`` or ``folder_times`` of its ``discovery`` bound the
    listing (``manifests.Bounds``). ``keep_corrupt`` marks what could not be read in a column ``_corrupt``.
    """
    source = extract["source"].lower()
    if source in jdbc.JDBC_KINDS:
        df = jdbc.read_table(
            spark,
            {**extract, "source": source},
            execution_date=execution_date,
            **extract.get("partitioning", {}),
        )
    elif source == "table":
        df = spark.table(extract["table"])
    elif source in ("csv", "s3"):
        df = _files(spark, extract, _needed(schema), control, job_name, keep_corrupt)
    elif source == "kafka":
        raw = streams.kafka_stream(
            spark, extract["servers"], extract["topic"], extract.get("consumer_group"), extract.get("max_offsets_per_trigger")
        )
        df = streams.parse_json(raw, _needed(schema), keep_corrupt=keep_corrupt)
    elif source == "json_files":
        raw = streams.text_stream(spark, extract["path"], extract.get("files_per_trigger"))
        df = streams.parse_json(raw, _needed(schema), keep_corrupt=keep_corrupt)
    else:
        raise ValueError(f"unknown source {source!r}")
    limit = extract.get("row_limit")
    return df if limit is None else row_limit(df, int(limit), extract.get("order_by", ()))


def _files(spark, extract, schema, control, job_name, keep_corrupt) -> DataFrame:
    path = extract.get("path") or f"s3a://{extract['bucket']}/{extract['prefix']}"
    path = path.rstrip("/")
    file_format = extract.get("file_format", "csv")
    if file_format == "csv":
        return files.read_csv(spark, path, schema, extract.get("columns"), keep_corrupt=keep_corrupt)
    if file_format != "jsonl_gz":
        raise ValueError(f"unknown file format {file_format!r}")
    discovery = extract.get("discovery", {})
    if discovery.get("method") != "manifest":
        return files.land(files.read_json_lines(spark, path, schema))
    mark = manifests.watermark(control, job_name) if control is not None else None
    bucket = f"s3a://{extract['bucket']}" if "bucket" in extract else None
    bounds = manifests.Bounds(**{k: discovery[k] for k in ("days", "lookback_days", "folder_times") if k in discovery})
    discovered = manifests.discover(spark, path, mark, key_root=bucket, bounds=bounds)
    found = manifests.present_and_missing(discovered, path)
    return files.land(files.read_json_lines(spark, manifests.file_list(found), schema))


def _needed(schema: T.StructType | None) -> T.StructType:
    if schema is None:
        raise ValueError("file and stream sources need a schema")
    return schema
