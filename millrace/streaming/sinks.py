"""Running a stream over what is available, into parquet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

BATCH = "batch_id"


def append_files(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Stateless or append-mode rows to parquet. Each micro-batch overwrites its own folder,
    so a batch that runs again after a failure does not double its rows."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return _start(stream, write, "append", checkpoint, trigger)


def replace_files(stream: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Complete-mode results: every micro-batch writes the whole result to its own folder."""

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/{BATCH}={batch_id}")

    return _start(stream, write, "complete", checkpoint, trigger)


def _start(stream, write, mode, checkpoint, trigger) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(write)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def finish(query: StreamingQuery, timeout_seconds: int | None = None) -> None:
    """Wait for a stream that ends by itself, however long its backlog takes; with a limit, stop
    it and fail when it is still running then."""
    if timeout_seconds is None:
        query.awaitTermination()
    elif not query.awaitTermination(timeout_seconds):
        query.stop()
        raise TimeoutError(f"stream still running after {timeout_seconds} s")


def appended(stream_output: DataFrame) -> DataFrame:
    """All appended rows."""
    return stream_output.drop(BATCH)


def latest(stream_output: DataFrame) -> DataFrame:
    """The rows of the last complete result. The batch folder is a partition, so the
    literal number prunes the read to one folder."""
    last = stream_output.selectExpr(f"max({BATCH}) AS last").first()["last"]
    return stream_output.where(f"{BATCH} = {last}").drop(BATCH)
