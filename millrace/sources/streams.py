"""JSON event streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.sources.files import CORRUPT


def kafka_stream(
    spark: SparkSession,
    servers: str,
    topic: str,
    consumer_group: str | None = None,
    max_offsets_per_trigger: int | None = None,
    starting_offsets: str = "earliest",
) -> DataFrame:
    """A Kafka topic as a stream; needs the Kafka package on the cluster's class path."""
    reader = (
        spark.readStream.format("kafka")
        .option("kafka.bootstrap.servers", servers)
        .option("subscribe", topic)
        .option("startingOffsets", starting_offsets)
    )
    if consumer_group:
        reader = reader.option("kafka.group.id", consumer_group)
    if max_offsets_per_trigger:
        reader = reader.option("maxOffsetsPerTrigger", max_offsets_per_trigger)
    return reader.load()


def text_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """JSON lines arriving as files, in the same ``value`` shape as Kafka."""
    reader = spark.readStream.format("text")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def parse_json(
    stream: DataFrame, schema: T.StructType, value: str = "value", keep_corrupt: bool = False
) -> DataFrame:
    """The declared fields of a JSON ``value`` column (text or bytes), batch or stream.

    A broken message is a row of NULLs; with ``keep_corrupt`` its text is in ``_corrupt``.
    """
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json(F.col(value).cast("string"), schema, options)
    return stream.select(parsed.alias("__record")).select("__record.*")
