"""Session settings the operators rely on, and the shared working folder."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping
from concurrent.futures import ThreadPoolExecutor
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Semantics (time zone, ANSI, timestamp type) and skew handling. Sizing, such as
# executor memory and the number of shuffle partitions, stays with the cluster.
REQUIRED_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.parquet.inferTimestampNTZ.enabled": "false",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Split a hot join key over several tasks, even where that costs one more shuffle.
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    # Pre-merge the sessions of a hot user on the map side of a streaming session window.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # Only partitions present in the written frame are replaced.
    "spark.sql.sources.partitionOverwriteMode": "dynamic",
}

_local_roots: dict[str, str] = {}


def prepare(spark: SparkSession) -> SparkSession:
    """Pin the settings above on an existing session."""
    for key, value in REQUIRED_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def local_session(app: str = "millrace", cores: str = "*", **settings: str) -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", "8")
        # Call-site capture per column costs driver time while plans are built.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    for key, value in settings.items():
        builder = builder.config(key, value)
    return prepare(builder.getOrCreate())


def shared_root(spark: SparkSession) -> str:
    """The folder every executor can reach: ``spark.checkpoint.dir`` of the session.

    Only a local session without that setting gets a temporary folder of its own.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    if context.applicationId not in _local_roots:
        _local_roots[context.applicationId] = tempfile.mkdtemp(prefix="millrace-")
        context.setCheckpointDir(_local_roots[context.applicationId])
    return _local_roots[context.applicationId]


_staging: list[list[str]] = []


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh, not yet existing path below the shared root."""
    path = f"{shared_root(spark)}/millrace/{purpose}-{uuid.uuid4().hex}"
    if _staging:
        _staging[-1].append(path)
    return path


@contextmanager
def staging(spark: SparkSession):
    """Deletes the folders that were made within when it ends, well or not.

    For a run whose results are in its targets: nothing lazy may still read its stages then.
    """
    paths: list[str] = []
    _staging.append(paths)
    try:
        yield
    finally:
        _staging.remove(paths)
        configuration = spark.sparkContext._jsc.hadoopConfiguration()
        for path in paths:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(configuration).delete(place, True)


def materialize(df: DataFrame, purpose: str = "stage") -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Used where one frame feeds several outputs: the upstream work runs once, and a
    lost executor costs a re-read of files rather than a recomputation.
    """
    spark = df.sparkSession
    path = shared_folder(spark, purpose)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, purpose: str = "source") -> tuple[DataFrame, int]:
    """``df`` and its number of rows, which no later plan, retry or lost executor can change.

    Files and tables are counted by a job without columns, for columnar files from their footers. Any other
    frame (a database, a limit, rows of the driver) is written first, so that what was counted is what
    is read.
    """
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    kinds = [leaves.apply(k).getClass().getSimpleName() for k in range(leaves.size())]
    if "HiveTableRelation" not in kinds and any(k != "LogicalRelation" for k in kinds):
        df = materialize(df, purpose)
    elif any(
        leaves.apply(k).relation().getClass().getSimpleName() != "HadoopFsRelation"
        for k, kind in enumerate(kinds) if kind == "LogicalRelation"
    ):
        df = materialize(df, purpose)
    return df, df.count()


def materialize_all(frames: Mapping[str, DataFrame]) -> dict[str, DataFrame]:
    """``materialize`` for independent frames, as concurrent jobs."""
    with ThreadPoolExecutor(max_workers=4) as pool:
        written = {name: pool.submit(materialize, df, name) for name, df in frames.items()}
        return {name: future.result() for name, future in written.items()}
