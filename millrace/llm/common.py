"""Helpers shared by the training-data operators."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, DataFrameWriter, SparkSession
from pyspark.sql import functions as F

from millrace.session import shared_folder


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the given tables."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Only the two columns an operator reads, as ``doc_id`` and ``text`` (null: empty)."""
    return docs.select(
        F.col(f"`{id_col}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"),
    )


def shipped(spark: SparkSession, value: object) -> Callable[[], object]:
    """A broadcast of an object of this package, which executors need not have; call it in a task."""
    packed = spark.sparkContext.broadcast(cloudpickle.dumps(value))
    return lambda: pickle.loads(packed.value)


# Spark's setting that removes the shuffle files of a finished query.
SHUFFLES_GO = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# How many files a task may write at once.
OPEN_FILES = "spark.sql.maxConcurrentOutputFileWriters"


class Stages:
    """Intermediate tables in the shared folder, each of which can be dropped when it is used up."""

    def __init__(self, spark: SparkSession, purpose: str):
        self.spark, self.purpose, self.paths = spark, purpose, {}

    def place(self, name: str) -> str:
        """A new path in the shared folder."""
        path = shared_folder(self.spark, f"{self.purpose}-{name}")
        self.paths.setdefault(name, []).append(path)
        return path

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """``df`` as a written table: later readers, and lost executors, read files again. So the shuffle
        files of the write go when it ends."""
        path = self.place(name)
        self._written(df.write, path)
        return self.spark.read.schema(df.schema).parquet(path)

    def write_kinds(self, df: DataFrame, kinds: dict[str, str]) -> list[DataFrame]:
        """The rows of each ``kind`` of ``df`` as a table of its own, of the columns given for it, from one pass."""
        path = self.place("kinds")
        before = self.spark.conf.get(OPEN_FILES, "0")
        self.spark.conf.set(OPEN_FILES, str(len(kinds)))  # else a task sorts its rows by kind
        try:
            self._written(df.write.partitionBy("kind"), path)
        finally:
            self.spark.conf.set(OPEN_FILES, before)
        # The folder of a kind without rows is missing.
        self.paths.pop("kinds")
        fs_path = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        fs = fs_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        for kind in kinds:
            self.paths.setdefault(kind, []).append(f"{path}/kind={kind}")
            fs.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/kind={kind}"))
        return [self.spark.read.schema(columns).parquet(f"{path}/kind={kind}") for kind, columns in kinds.items()]

    def _written(self, writer: DataFrameWriter, path: str) -> None:
        before = self.spark.conf.get(SHUFFLES_GO, "false")
        self.spark.conf.set(SHUFFLES_GO, "true")
        try:
            writer.parquet(path)
        finally:
            self.spark.conf.set(SHUFFLES_GO, before)

    def drop(self, *names: str) -> None:
        """Delete tables that no unfinished frame reads any more."""
        jvm, context = self.spark._jvm, self.spark.sparkContext
        for path in (p for n in names for p in self.paths.pop(n, [])):
            place = jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(context._jsc.hadoopConfiguration()).delete(place, True)


def runs(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Regroups sorted batches so that no run of equal ``key`` is cut; holds one run and one batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if held and keys[0] != held[-1].column(key)[-1].as_py():
            yield pa.Table.from_batches(held)
            held = []
        last = int(keys.searchsorted(keys[-1]))
        if last:
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)
