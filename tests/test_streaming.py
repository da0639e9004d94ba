from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from millrace.session import shared_folder
from millrace.streaming import sessions, sinks

SCHEMA = "id long, user string, ts timestamp, page string, device string"
DAY = 86_400


def add(spark, path, data):
    df = spark.createDataFrame(data, "id long, user string, secs long, page string, device string")
    df.select("id", "user", F.timestamp_seconds("secs").alias("ts"), "page", "device").coalesce(
        1
    ).write.mode("append").parquet(path)


def metrics(df):
    return sessions.session_stream(df, "user", "ts", "page", ["device"], ["ts", "id"])


def keyed(df):
    return {
        (r.user, r.session_start.timestamp()): (r.page_views, r.session_duration_sec, r.unique_pages, r.device)
        for r in df.collect()
    }


def test_append_closes_merges_and_drops_late_rows(spark):
    source, out, state = (shared_folder(spark, p) for p in ("s-src", "s-out", "s-state"))
    batches = [
        [(1, "u", 0, "/a", None), (2, "u", 600, "/b", "web"), (3, "v", 100, None, "web")],
        [(4, "u", 1500, "/a", "tv")],  # continues the open session
        [(5, "w", DAY, "/z", "web")],  # closes u and v
        [(6, "u", 1600, "/late", "web")],  # too late: dropped
        [(7, "x", 3 * DAY, "/z", "web")],  # closes w
    ]
    for data in batches:
        add(spark, source, data)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        sinks.finish(sinks.append_files(metrics(stream), out, state), 120)
    got = keyed(sinks.appended(spark.read.parquet(out)))
    assert got == {
        ("u", 0): (3, 1500.0, 2, "web"),
        ("v", 100): (0, 0.0, 0, "web"),
        ("w", DAY): (1, 0.0, 1, "web"),
    }


def test_complete_equals_batch(spark):
    source, out, state = (shared_folder(spark, p) for p in ("c-src", "c-out", "c-state"))
    data = [(i, f"u{i % 3}", (i * 977) % 40_000, f"/{i % 4}", "web" if i % 2 else None) for i in range(300)]
    for part in (data[:100], data[100:]):
        add(spark, source, part)
        stream = spark.readStream.schema(SCHEMA).parquet(source)
        sinks.finish(sinks.replace_files(metrics(stream), out, state, availableNow=True), 120)
    batch = metrics(spark.read.schema(SCHEMA).parquet(source))
    assert keyed(sinks.latest(spark.read.parquet(out))) == keyed(batch)


def test_endless_stream_is_stopped(spark):
    source, out, state = (shared_folder(spark, p) for p in ("e-src", "e-out", "e-state"))
    add(spark, source, [(1, "u", 0, "/a", None)])
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    query = sinks.append_files(stream, out, state, processingTime="1 second")
    with pytest.raises(TimeoutError):
        sinks.finish(query, 3)
    assert not query.isActive
