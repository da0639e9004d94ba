"""The load journal: all changes of a run, kept until the last of them is published.

A run prepares its loads, commits them here as one batch, and then publishes. Death before the
commit leaves every table as it was. Death after it leaves an open batch, which the next run
publishes first (``finish_open``); publishing is repeatable, so no row is lost or doubled.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence
from dataclasses import asdict

from pyspark.sql import SparkSession

from millrace.sinks.tables import Change, publish

PREPARED, DONE = "prepared", "done"


def commit(spark: SparkSession, journal: str, changes: Sequence[Change], batch: str | None = None) -> str:
    """Record the changes of a batch; from here on they will be published. A batch that a caller names
    is one that may be tried again, see ``closed``."""
    batch = batch or uuid.uuid4().hex
    rows = [(k, json.dumps(asdict(c))) for k, c in enumerate(changes)]
    state = spark.createDataFrame(rows, "position INT, change STRING").coalesce(1)
    state.write.mode("overwrite").parquet(f"{journal}/state={PREPARED}/batch={batch}")
    return batch


def complete(spark: SparkSession, journal: str, batch: str) -> None:
    """Publish a committed batch and close it."""
    for change in _changes(spark, journal, batch):
        publish(spark, change)
    done = spark.createDataFrame([(0, "")], "position INT, change STRING").coalesce(1)
    done.write.mode("overwrite").parquet(f"{journal}/state={DONE}/batch={batch}")
    # Only open batches are listed when the next run begins, however many there have been.
    delete(spark, f"{journal}/state={PREPARED}/batch={batch}")


def closed(spark: SparkSession, journal: str, batch: str) -> bool:
    """Whether a named batch has been published."""
    return _exists(spark, f"{journal}/state={DONE}/batch={batch}")


def finish_open(spark: SparkSession, journal: str) -> list[str]:
    """Publish what an earlier run has committed and not closed; returns the batches."""
    place = _path(spark, f"{journal}/state={PREPARED}")
    system = place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not system.exists(place):
        return []
    named = [status.getPath() for status in system.listStatus(place) if status.isDirectory()]
    # A folder without its one file is a commit that was cut off: nothing of it has been published.
    written = [p for p in named if any(f.getPath().getName().startswith("part-") for f in system.listStatus(p))]
    whole = sorted(p.getName().split("=", 1)[1] for p in written)
    finished = [b for b in whole if not closed(spark, journal, b)]
    for batch in finished:
        complete(spark, journal, batch)
    return finished


def load_all(spark: SparkSession, journal: str, changes: Sequence[Change]) -> str:
    """Commit and publish."""
    batch = commit(spark, journal, changes)
    complete(spark, journal, batch)
    return batch


def _changes(spark: SparkSession, journal: str, batch: str) -> list[Change]:
    rows = spark.read.parquet(f"{journal}/state={PREPARED}/batch={batch}").orderBy("position").collect()
    found = [json.loads(r["change"]) for r in rows]
    return [Change(c["table"], tuple(map(tuple, c["moves"])), tuple(c["statements"])) for c in found]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _exists(spark: SparkSession, path: str) -> bool:
    place = _path(spark, path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def delete(spark: SparkSession, path: str) -> None:
    """Remove a folder, if it is there."""
    place = _path(spark, path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)
