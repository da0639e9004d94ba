"""Declared streams: sessions over micro-batches, late rows, and runs that die."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.control import runs
from millrace.operators import aggregates
from millrace.plans import stream_runner
from millrace.plans.runner import read_rejects, run_spec
from millrace.session import shared_folder
from millrace.sinks import journal, tables

CLICKS = T.StructType(
    [
        T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("page_url", T.StringType()),
        T.StructField("timestamp", T.TimestampType()), T.StructField("device_type", T.StringType()),
    ]
)
TARGET = "user_id BIGINT, session_id BIGINT, page_views BIGINT, session_duration_sec DOUBLE, unique_pages BIGINT, device_type STRING, country STRING, load_date DATE"
FLUSH = (10**6, -1, "/end", 10**9, "web")


def land(spark, path, rows, extra=()):
    """One file of JSON lines."""
    df = spark.createDataFrame(rows, "event_id long, user_id long, page_url string, secs long, device_type string")
    made = df.select("event_id", "user_id", "page_url", F.timestamp_seconds("secs").alias("timestamp"), "device_type")
    text = made.select(F.to_json(F.struct("*")).alias("value"))
    if extra:
        text = text.unionByName(spark.createDataFrame([(x,) for x in extra], "value string"))
    text.coalesce(1).write.mode("append").text(path)


class Feed:
    def __init__(self, spark):
        self.spark, self.source, self.control = spark, shared_folder(spark, "feed"), shared_folder(spark, "control")
        self.target, self.late = (f"{n}_{uuid.uuid4().hex}" for n in ("sessions", "late"))
        self.users = spark.createDataFrame([(k, f"C{k % 3}", "gold") for k in range(5)], "user_id long, country string, account_type string")
        folder = shared_folder(spark, "target")
        self.spec = {
            "name": "clicks",
            "extract": {"source": "json_files", "path": self.source, "files_per_trigger": 1, "watermark": {"delay_minutes": 10}},
            "transform": {"steps": [
                {"filter_bots": {"condition": "device_type != 'bot'"}},
                {"sessionize": {"partition_by": "user_id", "order_by": "timestamp", "inactivity_gap_minutes": 30, "output_column": "session_id"}},
                {"enrich_user_profile": {"lookup_table": "users", "join_key": "user_id", "fields": ["country", "account_type"]}},
                {"aggregate_sessions": {
                    "group_by": ["user_id", "session_id"],
                    "metrics": {"page_views": "count(page_url)", "session_duration_sec": "max(timestamp) - min(timestamp)", "unique_pages": "count_distinct(page_url)"},
                    "keep_first": ["device_type", "country"], "order_by": ["timestamp", "event_id"],
                }},
            ]},
            "quality_checks": {"pre_load": [{"row_count_gt": 0}, {"required_fields_not_null": {"fields": ["user_id", "session_id", "page_views"]}}]},
            "load": {
                "late_rows": {"table": self.late, "path": shared_folder(spark, "late")},
                "destinations": [{"table": self.target, "path": folder, "target_ddl": TARGET, "mode": "append"}],
            },
        }

    def run(self):
        return run_spec(self.spark, self.spec, self.control, CLICKS, {"users": self.users}).first()

    def sessions(self):
        return sorted(
            (r.user_id, r.session_id // 10**6, r.page_views, r.session_duration_sec, r.unique_pages, r.device_type, r.country)
            for r in self.spark.table(self.target).where("user_id >= 0").collect()
        )

    def expected(self, rows):
        df = self.spark.createDataFrame(rows, "event_id long, user_id long, page_url string, secs long, device_type string")
        df = df.where("device_type IS NULL OR device_type != 'bot'").withColumn("timestamp", F.timestamp_seconds("secs"))
        metrics = aggregates.session_metrics(df, "user_id", "timestamp", "page_url", ["device_type"], ["timestamp", "event_id"])
        starts = aggregates.session_metrics(
            df.withColumn("at", F.col("secs")), "user_id", "timestamp", "page_url", ["at"], ["timestamp", "event_id"]
        ).select("user_id", "session_id", "at")
        joined = metrics.join(starts, ["user_id", "session_id"]).join(self.users, "user_id", "left")
        return sorted((r.user_id, r["at"], r.page_views, r.session_duration_sec, r.unique_pages, r.device_type, r.country) for r in joined.collect())


def clicks(n, start=0, step=97):
    return [(start + i, i % 7, f"/{i % 4}" if i % 5 else None, start * step + i * step, ["web", "bot", None, "tv"][i % 4]) for i in range(n)]


def test_micro_batches_equal_the_batch(spark):
    feed = Feed(spark)
    rows = clicks(300) + clicks(300, 300)
    for k in range(0, 600, 150):  # files in the order of time, several micro-batches in one run
        land(spark, feed.source, rows[k : k + 150])
    first = feed.run()
    assert first.load_status == "Success" and first.source_count == 600 and 0 < first.target_count
    land(spark, feed.source, [FLUSH])
    second = feed.run()
    assert second.source_count == 1
    assert feed.sessions() == feed.expected(rows)
    assert first.target_count + second.target_count == len(feed.sessions())
    # Nothing new: nothing is loaded again.
    assert feed.run().source_count == 0 and feed.sessions() == feed.expected(rows)


def test_late_rows_go_to_their_table(spark):
    feed = Feed(spark)
    on_time = [(1, 1, "/a", 0, "web"), (2, 1, "/b", 600, "web"), (3, 2, "/a", 50_000, "web")]
    late = [(4, 1, "/late", 700, "web"), (5, 9, "/late", 49_399, "bot")]
    more = [(6, 2, "/c", 49_400, "web"), (7, 3, None, None, "web")]  # at the watermark; without a time
    land(spark, feed.source, on_time)
    feed.run()
    land(spark, feed.source, late + more, extra=["{broken", ""])
    land(spark, feed.source, [FLUSH])
    record = feed.run()
    assert sorted(r.event_id for r in spark.table(feed.late).collect()) == [4, 5]
    assert feed.sessions() == feed.expected(on_time + more[:1])
    marks = spark.read.schema(stream_runner.MARK_SCHEMA).option("recursiveFileLookup", True).parquet(f"{feed.control}.stream/clicks/mark").collect()
    assert all(m.late_rows + m.on_time_rows + m.corrupt_rows == m.rows_read for m in marks)
    written = {(r.job_name, r.source_count, r.target_count) for r in runs.read_control(spark, feed.control).collect()}
    assert ("clicks.late_rows", record.source_count, 2) in written
    assert [r.record for r in read_rejects(spark, feed.control).collect()] == ["{broken"]


@pytest.mark.parametrize("point", ["prepare", "commit", "publish", "half", "close"])
def test_runs_that_die_load_each_row_once(spark, monkeypatch, point):
    """Death before the commit, after it, between two tables, and before the batch is closed."""
    feed = Feed(spark)
    rows = clicks(200)
    land(spark, feed.source, rows)
    land(spark, feed.source, [FLUSH])
    land(spark, feed.source, [(7, 1, "/late", 5, "web")])

    calls = []

    def dying(real, after):
        def call(*args, **more):
            calls.append(1)
            if len(calls) > after:
                raise RuntimeError("the driver died")
            return real(*args, **more)

        return call

    with monkeypatch.context() as m:
        if point == "prepare":
            m.setattr(tables, "prepare_append", dying(tables.prepare_append, 0))
        elif point == "commit":
            m.setattr(journal, "commit", dying(journal.commit, 1))
        elif point in ("publish", "half"):
            m.setattr(journal, "publish", dying(journal.publish, int(point == "half")))
        else:
            m.setattr(journal, "delete", dying(journal.delete, 0))
        with pytest.raises(Exception):
            feed.run()
    feed.run()
    assert feed.sessions() == feed.expected(rows)
    assert [r.event_id for r in spark.table(feed.late).collect()] == [7]
    statuses = [r.load_status for r in runs.read_control(spark, feed.control).where("job_name = 'clicks'").orderBy("created_on").collect()]
    assert statuses == ["Failed", "Success"]


def test_state_of_a_hot_user_is_bounded(spark):
    """20,000 clicks of one user in one open session: rows of the state are slots times pages."""
    feed = Feed(spark)
    rows = [(i, 1, f"/{i % 3}", i // 4, "web") for i in range(20_000)]
    land(spark, feed.source, rows)
    feed.run()
    mark = spark.read.schema(stream_runner.MARK_SCHEMA).option("recursiveFileLookup", True).parquet(f"{feed.control}.stream/clicks/mark").first()
    assert mark.on_time_rows == 20_000 and mark.open_rows <= 3 * 3
    land(spark, feed.source, [FLUSH])
    feed.run()
    assert feed.sessions() == [(1, 0, 20_000, 4999.0, 3, "web", "C1")]


def test_stateless_streams_and_refusals(spark):
    feed = Feed(spark)
    feed.spec["transform"]["steps"] = [{"derive_column": {"target_field": "path", "expression": "upper(page_url)"}}]
    feed.spec["extract"]["watermark"] = {"column": "timestamp", "delay_minutes": 10}
    feed.spec["quality_checks"] = {}
    feed.spec["load"]["destinations"][0] |= {"target_ddl": "event_id BIGINT, path STRING"}
    land(spark, feed.source, [(1, 1, "/a", 5000, None)])
    feed.run()
    land(spark, feed.source, [(2, 1, "/b", 4400, None), (3, 1, "/c", 4399, None)])
    record = feed.run()
    assert sorted(map(tuple, spark.table(feed.target).collect())) == [(1, "/A"), (2, "/B")]
    # Late and loaded rows are all that were read.
    assert record.source_count == record.target_count + 1 == 2 and spark.table(feed.late).count() == 1
    for step in ({"sort_rows": {"by": ["event_id"]}}, {"aggregate": {"group_by": ["user_id"], "metrics": {}}}, "deduplicate:x"):
        with pytest.raises(ValueError, match="stream"):
            stream_runner.plan_steps([step])
    feed.spec["load"]["destinations"] = [{"engine": "mysql", "table": "t"}]
    with pytest.raises(ValueError, match="database"):
        feed.run()
