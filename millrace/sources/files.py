"""File sources. Every read states its schema; nothing is inferred."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.session import materialize

CORRUPT = "_corrupt"
Shape = Callable[[DataFrame], DataFrame]


def read_csv(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    columns: Sequence[str] | None = None,
    header: bool = True,
    keep_corrupt: bool = False,
) -> DataFrame:
    """CSV file, folder or object-store prefix with declared columns.

    A field that does not fit its type is NULL. With ``keep_corrupt`` such a line is also kept
    as text in ``_corrupt``, so that it can be counted or rejected.
    """
    paths = path if isinstance(path, str) else list(path)
    if keep_corrupt:
        schema = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
        columns = [*columns, CORRUPT] if columns else None
    df = (
        spark.read.schema(schema)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("header", header)
        .option("enforceSchema", not header)
        .csv(paths)
    )
    return df.select(*columns) if columns else df


def read_json_lines(
    spark: SparkSession,
    path: str | Sequence[str],
    schema: T.StructType,
    modified_after: str | None = None,
    spread: int | None = None,
) -> DataFrame:
    """Line-delimited JSON, gzipped or not, with ``source_file`` and ``_corrupt`` columns.

    A line that does not parse is kept as text in ``_corrupt``. A file that is gone, is cut off
    or is no gzip fails the read: a part of it would pass for the whole (see ``land_folders``).
    Gzip cannot be split, so a file is one task: give ``spread`` when a few big files would
    leave the cluster idle.
    """
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    reader = (
        spark.read.schema(with_corrupt)
        .option("columnNameOfCorruptRecord", CORRUPT)
        .option("ignoreCorruptFiles", False)
        .option("ignoreMissingFiles", False)
    )
    if modified_after is not None:
        reader = reader.option("modifiedAfter", modified_after)
    paths = path if isinstance(path, str) else list(path)
    # The metadata path is URL-encoded; a plus sign in it is literal. Most paths need no decoding.
    path = F.col("_metadata.file_path")
    decoded = F.url_decode(F.regexp_replace(path, r"\+", "%2B"))
    df = reader.json(paths).withColumn("source_file", F.when(path.contains("%"), decoded).otherwise(path))
    return df.repartition(spread) if spread else df


def land(raw: DataFrame) -> DataFrame:
    """The records as a columnar copy in the shared folder.

    For a feed that is used more than once (records, file tracking, folder outcomes): the text
    is unpacked and parsed once, and the corrupt marks cannot change with the columns a
    later query happens to read, as they would on a pruned text scan.
    """
    return materialize(raw, "landing")


def land_folders(
    spark: SparkSession, found: DataFrame, schema: T.StructType, target: str, shape: Shape | None = None
) -> list[str]:
    """Land the present files of a bounded group of folders below ``target``; returns the folders
    that cannot be read whole.

    ``found`` lists (folder, data_file, bytes). ``shape`` turns the read records row by row into those that are
    landed, so that only one copy of them is written; it keeps ``source_file`` and ``_corrupt``. All files are one job. If that fails, one more job looks
    for damaged files, and one lands the folders that have none. A failure that no damaged file
    explains (the store, memory, a permission) is raised: it says nothing about the folders.
    """
    by_folder: dict[str, list[str]] = {}
    for row in found.where("bytes IS NOT NULL").select("folder", "data_file").distinct().collect():
        by_folder.setdefault(row["folder"], []).append(row["data_file"])
    every = sorted(f for names in by_folder.values() for f in names)
    if not every:
        return []
    try:
        _land_files(spark, every, schema, f"{target}/part=0", shape)
        return []
    except (PySparkException, Py4JJavaError):  # the files of the failed attempt are removed by the writer
        bad = {row["file"] for row in gzip_integrity(spark, every).where("NOT ok").collect()}
        if not bad:
            raise
    unreadable = sorted(folder for folder, names in by_folder.items() if bad & set(names))
    good = sorted(f for folder, names in by_folder.items() if folder not in unreadable for f in names)
    if good:
        _land_files(spark, good, schema, f"{target}/part=1", shape)
    return unreadable


def _land_files(
    spark: SparkSession, paths: list[str], schema: T.StructType, target: str, shape: Shape | None = None
) -> None:
    raw = read_json_lines(spark, paths, schema)
    (shape(raw) if shape else raw).write.mode("overwrite").parquet(target)


def gzip_integrity(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """(file, ok, reason) of each path: whether a ``.gz`` file can be unpacked, member by member, up to its last
    trailer. Other files are only looked up. A file that is gone is not ok.

    One job over all files; a task holds one compressed file (up to Spark's 2 GB of a binary row)
    and unpacks it in pieces. A store or permission error fails the job.
    """
    listed = spark.createDataFrame([(p,) for p in dict.fromkeys(paths)], "file STRING")
    reader = spark.read.format("binaryFile").option("ignoreMissingFiles", True)
    content = reader.load(list(dict.fromkeys(paths))).select(F.col("path"), F.col("content"))
    looked = content.mapInArrow(_unpacker(), "path STRING, reason STRING")
    plain = F.regexp_replace(F.col("file"), r"^[a-z0-9]+:/+", "/")
    looked = looked.select(F.regexp_replace("path", r"^[a-z0-9]+:/+", "/").alias("__plain"), "reason", F.lit(True).alias("__there"))
    reason = F.when(F.col("__there"), F.col("reason")).otherwise(F.lit("gone"))
    return listed.join(looked, plain == F.col("__plain"), "left").select("file", reason.isNull().alias("ok"), reason.alias("reason"))


def _unpacker():
    """The task function of ``gzip_integrity``, made here so that it travels by value."""

    def fault(data: memoryview) -> str | None:
        import zlib

        at = 0
        while True:
            unpack = zlib.decompressobj(wbits=31)
            while not unpack.eof:
                piece = data[at : at + (1 << 16)]
                if not piece:
                    return "cut off"
                at += len(piece)
                try:
                    unpack.decompress(bytes(piece))
                except zlib.error as error:
                    return f"damaged: {error}"
            at -= len(unpack.unused_data)
            if not bytes(data[at : at + 512]).strip(b"\0"):  # some writers pad with zeros
                return None

    def unpacked(batches):
        import pyarrow as pa

        for batch in batches:
            for path, content in zip(batch.column("path"), batch.column("content")):
                name = path.as_py()
                reason = fault(memoryview(content.as_buffer())) if name.endswith(".gz") else None
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([reason], pa.string())], ["path", "reason"])

    return unpacked


def landed(spark: SparkSession, schema: T.StructType, root: str, shape: Shape | None = None) -> DataFrame:
    """All that ``land_folders`` has put below ``root``, with the same ``shape``."""
    columns = [*schema.fields, *(T.StructField(c, T.StringType()) for c in (CORRUPT, "source_file"))]
    # An empty part, so that there is something to read when no file was good.
    empty = spark.createDataFrame([], T.StructType(columns))
    empty = shape(empty) if shape else empty
    empty.write.mode("overwrite").parquet(f"{root}/part=none")
    reader = spark.read.schema(empty.schema).option("recursiveFileLookup", True)
    return reader.parquet(root)


def run_query(spark: SparkSession, query: str, execution_date: str, **tables: DataFrame):
    """A query with ``:execution_date`` as a bound parameter, over frames named ``{name}``."""
    return spark.sql(query, args={"execution_date": execution_date}, **tables)
