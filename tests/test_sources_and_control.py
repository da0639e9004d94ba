from __future__ import annotations

import datetime
import gzip
import json
import os
from decimal import Decimal

import pytest
from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.control import runs
from millrace.plans import daily
from millrace.session import REQUIRED_SETTINGS, shared_folder, shared_root
from millrace.sources import extract as extracted
from millrace.sources import files, jdbc, manifests, streams

UTC = datetime.timezone.utc
SCHEMA = T.StructType([T.StructField("a", T.LongType())])


def write_gz(path, lines):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with gzip.open(path, "wt") as out:
        out.write("\n".join(lines))


def manifest(folder, paths, at):
    path = f"{folder}/{manifests.MANIFEST_FILE}"
    with open(path, "w") as out:
        out.write("\n".join(json.dumps({manifests.DATA_KEY_FIELD: p}) for p in paths))
    os.utime(path, (at, at))


@pytest.fixture
def feed(tmp_path):
    """Three folders: good, with an unreadable file, with an absent file."""
    root = str(tmp_path / "feed")
    good, bad, gone = (f"{root}/{n}" for n in ("good", "bad", "gone"))
    write_gz(f"{good}/data 1+2%.json.gz", ['{"a": 1}', '{"a": "x', '{"a": 3}'])
    write_gz(f"{bad}/ok.json.gz", ['{"a": 4}'])
    with open(f"{bad}/broken.json.gz", "wb") as out:
        out.write(b"this is not gzip")
    write_gz(f"{gone}/here.json.gz", ['{"a": 5}'])
    manifest(good, ["good/data 1+2%.json.gz"], 1_700_000_000)
    manifest(bad, [f"{bad}/ok.json.gz", f"{bad}/broken.json.gz"], 1_700_000_100)
    manifest(gone, [f"{gone}/here.json.gz", f"{gone}/not-here.json.gz"], 1_700_000_200)
    return root


def found_in(spark, feed, newer_than=None):
    return manifests.present_and_missing(manifests.discover(spark, feed, newer_than, key_root=feed), feed)


def land(spark, found):
    root = shared_folder(spark, "land-test")
    unreadable = files.land_folders(spark, found, SCHEMA, f"{root}/group=0")
    return files.landed(spark, SCHEMA, root), unreadable


def test_bad_lines_are_kept_and_bad_files_fail_the_read(spark, feed):
    found = found_in(spark, feed)
    raw, unreadable = land(spark, found)
    rows = raw.collect()
    assert sorted(r.a for r in rows if r.a is not None) == [1, 3, 5] and unreadable == ["bad"]
    assert [r[files.CORRUPT] for r in rows if r[files.CORRUPT]] == ['{"a": "x']
    with pytest.raises((PySparkException, Py4JJavaError)):
        files.read_json_lines(spark, manifests.file_list(found), SCHEMA).collect()


def test_a_cut_file_gives_no_row_and_an_empty_one_is_good(spark, tmp_path):
    for name in ("cut", "empty", "whole"):
        write_gz(f"{tmp_path}/{name}/d.json.gz", [] if name == "empty" else ['{"a": %d}' % k for k in range(5000)])
        manifest(f"{tmp_path}/{name}", [f"{tmp_path}/{name}/d.json.gz"], 1_700_000_000)
    cut = tmp_path / "cut" / "d.json.gz"
    whole = cut.read_bytes()
    cut.write_bytes(whole[: len(whole) * 6 // 10])
    found = found_in(spark, str(tmp_path))
    raw, unreadable = land(spark, found)
    assert unreadable == ["cut"] and raw.count() == 5000
    outcomes = {r.folder: (r.status, r.raw_count) for r in runs.folder_outcomes(found, raw, unreadable).collect()}
    assert outcomes == {"cut": ("Failed", 0), "empty": ("Success", 0), "whole": ("Success", 5000)}
    read = found.where("folder <> 'cut'")
    tracked = runs.file_tracking(raw, "job", datetime.datetime(2024, 1, 1, tzinfo=UTC), read).collect()
    assert sorted(r.raw_count for r in tracked) == [0, 5000]


def test_folder_outcomes(spark, feed):
    found = found_in(spark, feed)
    raw, unreadable = land(spark, found)
    outcomes = runs.folder_outcomes(found, raw, unreadable)
    got = {r.folder: (r.status, r.files, r.failed_files, r.raw_count, r.corrupt_count) for r in outcomes.collect()}
    assert got == {
        "good": ("Success", 1, 0, 3, 1),
        "bad": ("Failed", 2, 2, 0, 0),
        "gone": ("Failed", 2, 1, 1, 0),
    }
    assert outcomes.agg(runs.run_status(outcomes)).first()[0] == "Partial"
    assert outcomes.where("folder <> 'good'").agg(runs.run_status(outcomes)).first()[0] == "Failed"
    assert [runs.exit_code(s) for s in ("Success", "Partial", "Failed")] == [0, 1, 1]


def test_watermark_selects_newer_manifests(spark, feed):
    mark = datetime.datetime.fromtimestamp(1_700_000_100, UTC).replace(tzinfo=None)
    assert {r.folder for r in found_in(spark, feed, mark).collect()} == {"gone"}
    assert {r.folder for r in found_in(spark, feed).collect()} == {"good", "bad", "gone"}


def record(spark, status, hour, source=1, target=1):
    at = datetime.datetime(2024, 1, 1, hour, tzinfo=UTC)
    return runs.control_record(spark, "job", source, target, status, at, at, at.date())


def test_only_success_moves_the_watermark(spark):
    path = shared_folder(spark, "control-test")
    for status, hour in (("Success", 1), ("Partial", 2), ("Failed", 3)):
        runs.append_record(record(spark, status, hour), path)
    control = runs.read_control(spark, path)
    assert manifests.watermark(control, "job") == datetime.datetime(2024, 1, 1, 1)
    assert manifests.watermark(control, "other") is None
    checked = {r.load_status: r.passed for r in runs.status_check(control).collect()}
    assert checked == {"Success": True, "Partial": True, "Failed": False}
    with pytest.raises(ValueError, match="ended Failed"):
        runs.require_status(control)


def test_count_check(spark):
    control = record(spark, "Success", 1, 0, 0).unionByName(record(spark, "Success", 2, 5, 0))
    assert sorted((r.source_count, r.passed) for r in runs.count_check(control).collect()) == [(0, True), (5, False)]


def test_unknown_control_field(spark):
    at = datetime.datetime(2024, 1, 1, tzinfo=UTC)
    with pytest.raises(ValueError, match="colour"):
        runs.control_record(spark, "job", 0, 0, "Success", at, at, at.date(), colour="red")


def test_counters(spark):
    marked = spark.createDataFrame([(None,), ("early",), ("late",), (None,)], "reject_reason string")
    got = runs.counters(marked, ["early"]).first()
    assert tuple(got) == (4, 3, 2, 2)


def test_csv_declared_columns(spark, tmp_path):
    path = str(tmp_path / "w.csv")
    with open(path, "w") as out:
        out.write("date,city,temp_f,humidity,wind_speed\n2024-01-02,Oslo,32,80,\n,Rome,,1,2\n")
    df = files.read_csv(spark, path, daily.WEATHER_SCHEMA)
    got = [tuple(r) for r in daily.weather(df).collect()]
    assert got == [(datetime.date(2024, 1, 2), "Oslo", 0.0, 80, None)]


def test_query_parameter_is_bound_not_pasted(spark):
    df = spark.createDataFrame([("2024-01-01",), ("2024-01-02",)], "d string")
    query = "SELECT d FROM {t} WHERE d = :execution_date"
    assert files.run_query(spark, query, "2024-01-02", t=df).count() == 1
    assert files.run_query(spark, query, "x' OR '1'='1", t=df).count() == 0


def test_jdbc_read_options(monkeypatch):
    monkeypatch.setenv("PW", "s")
    base = {"source": "postgres", "host": "h", "username": "u", "password_env_var": "PW", "database": "d"}
    assert jdbc.read_options({**base, "table": "t"}) == {
        "url": "jdbc:postgresql://h:5432/d",
        "user": "u",
        "password": "s",
        "fetchsize": "10000",
        "dbtable": "t",
    }
    ranged = jdbc.read_options({**base, "query": "SELECT 1"}, "id", 0, 100, 4)
    assert ranged["dbtable"] == "(SELECT 1) source_query" and ranged["numPartitions"] == "4"
    assert jdbc.read_options({**base, "query": "SELECT 1"})["query"] == "SELECT 1"
    dated = {**base, "query": "SELECT * FROM t WHERE d = '{{execution_date}}'"}
    day = datetime.date(2024, 1, 2)
    assert jdbc.read_options(dated, execution_date=day)["query"] == "SELECT * FROM t WHERE d = '2024-01-02'"
    with pytest.raises(TypeError):
        jdbc.read_options(dated, execution_date="2024'; --")
    for kind, start in (("mysql", "jdbc:mysql:"), ("mssql", "jdbc:sqlserver:"), ("oracle", "jdbc:oracle:"), ("sqlite", "jdbc:sqlite:")):
        assert jdbc.connection_options({"source": kind, "database": "d"})["url"].startswith(start)
    with pytest.raises(ValueError, match="unknown database kind"):
        jdbc.connection_options({"source": "dbase", "database": "d"})


def test_jdbc_ranges_from_the_extent_of_a_column(spark, monkeypatch):
    assert jdbc.ranges(1, 10_000_000, 10_000_000) == {"lower_bound": 1, "upper_bound": 10_000_000, "num_partitions": 10}
    assert jdbc.ranges(Decimal("0.5"), Decimal("9.5"), 31, 10) == {"lower_bound": 0, "upper_bound": 10, "num_partitions": 4}
    first, last = datetime.date(2024, 1, 1), datetime.date(2024, 2, 1)
    assert jdbc.ranges(first, last, 20, 10)["upper_bound"] == "2024-02-01"
    at = datetime.datetime(2024, 1, 1, 12, 30)
    assert jdbc.ranges(at, at + datetime.timedelta(days=1), 20, 10)["lower_bound"] == "2024-01-01 12:30:00.000000"
    for none in ((None, None, 50), (1, 1, 50), (1, 9, 10)):
        assert jdbc.ranges(*none, rows_per_partition=10) == {}
    with pytest.raises(ValueError, match="str column"):
        jdbc.ranges("a", "b", 50, 10)

    asked = []  # no database is started: what would be read, in order

    def load(spark, options):
        asked.append(options)
        return spark.createDataFrame([(5, 104, 100)], "low long, high long, n long")

    monkeypatch.setattr(jdbc, "_load", load)
    source = {"source": "postgres", "database": "d", "query": "SELECT * FROM t WHERE d = '{{execution_date}}'"}
    extract = {**source, "partitioning": {"partition_column": "id", "rows_per_partition": 30}}
    extracted.open_source(spark, extract, execution_date=datetime.date(2024, 1, 2))
    inner = "(SELECT * FROM t WHERE d = '2024-01-02') source_query"
    assert asked[0]["query"] == f"SELECT MIN(id) AS low, MAX(id) AS high, COUNT(*) AS n FROM {inner}"
    assert not {"dbtable", "partitionColumn", "numPartitions"} & set(asked[0])
    ranged = [asked[1][k] for k in ("dbtable", "partitionColumn", "lowerBound", "upperBound", "numPartitions")]
    assert ranged == [inner, "id", "5", "104", "4"]
    jdbc.read_table(spark, {**source, "query": "SELECT 1"}, "id")  # 100 rows: one task
    assert "partitionColumn" not in asked[3] and asked[3]["query"] == "SELECT 1"
    jdbc.read_table(spark, {"source": "postgres", "database": "d", "table": "t"}, "id", lower_bound=0, upper_bound=9, num_partitions=3)
    assert len(asked) == 5 and asked[4]["numPartitions"] == "3"


def test_json_values_parse_as_text_or_bytes(spark):
    df = spark.createDataFrame([('{"a": 5}',), ("junk",)], "value string")
    assert [r.a for r in streams.parse_json(df, SCHEMA).collect()] == [5, None]
    as_bytes = df.select(F.col("value").cast("binary"))
    assert [r.a for r in streams.parse_json(as_bytes, SCHEMA).collect()] == [5, None]


def test_session_settings(spark):
    assert all(spark.conf.get(k) == v for k, v in REQUIRED_SETTINGS.items())
    first, second = shared_folder(spark, "x"), shared_folder(spark, "x")
    assert first != second and first.startswith(shared_root(spark))


def test_broken_fields_and_messages_leave_a_mark(spark, tmp_path):
    (tmp_path / "d.csv").write_text("a,b\n1,x\nabc,y\n")
    schema = T.StructType([T.StructField("a", T.LongType()), T.StructField("b", T.StringType())])
    rows = files.read_csv(spark, str(tmp_path / "d.csv"), schema, ["a"], keep_corrupt=True).collect()
    assert sorted(map(tuple, rows), key=str) == [(1, None), (None, "abc,y")]
    assert files.read_csv(spark, str(tmp_path / "d.csv"), schema).columns == ["a", "b"]
    sent = spark.createDataFrame([('{"a": 1}',), ('{"a": ',)], "value string")
    got = streams.parse_json(sent, SCHEMA, keep_corrupt=True).collect()
    assert sorted((r.a, r[files.CORRUPT]) for r in got if r.a) == [(1, None)]
    assert [r[files.CORRUPT] for r in got if r.a is None] == ['{"a": ']


def _names_read(df):
    """The files a lazy read has listed."""
    return sorted(df.inputFiles())


def test_a_bounded_listing_looks_only_into_new_folders(spark, tmp_path):
    old, new = 1_700_000_000, 1_700_000_200
    for k in range(5000):
        (tmp_path / f"old{k:04d}").mkdir()
        os.utime(tmp_path / f"old{k:04d}", (old, old))
    for name, at in (("old0001", old), ("new[1]", new), ("new2", new)):
        write_gz(f"{tmp_path}/{name}/d.json.gz", ['{"a": 1}'])
        manifest(f"{tmp_path}/{name}", [f"{tmp_path}/{name}/d.json.gz"], at)
        os.utime(tmp_path / name, (at, at))
    (tmp_path / "new3").mkdir()  # its manifest has yet to come
    mark = datetime.datetime.fromtimestamp(1_700_000_100, UTC).replace(tzinfo=None)
    bounded = manifests.discover(spark, str(tmp_path), mark, bounds=manifests.Bounds(folder_times=True))
    assert len(_names_read(bounded)) == 2
    assert {r.folder for r in bounded.collect()} == {"new[1]", "new2"}
    assert {tuple(r) for r in bounded.collect()} == {tuple(r) for r in manifests.discover(spark, str(tmp_path), mark).collect()}
    there = manifests.present_and_missing(bounded, str(tmp_path)).where("bytes > 0")
    assert {r.folder for r in there.collect()} == {"new[1]", "new2"}
    late = datetime.datetime(2100, 1, 1)
    assert manifests.discover(spark, str(tmp_path), late, bounds=manifests.Bounds(folder_times=True)).collect() == []


def test_day_folders_bound_a_listing(spark, tmp_path):
    now = datetime.datetime.now(UTC)
    days = {n: (now - datetime.timedelta(days=n)).strftime("%Y/%m/%d") for n in (40, 3, 1, 0)}
    for n, day in days.items():
        write_gz(f"{tmp_path}/{day}/f/d.json.gz", ['{"a": %d}' % n])
        manifest(f"{tmp_path}/{day}/f", [f"{tmp_path}/{day}/f/d.json.gz"], now.timestamp())
    (tmp_path / (now + datetime.timedelta(days=1)).strftime("%Y/%m/%d")).mkdir(parents=True)  # empty
    mark = (now - datetime.timedelta(days=1, minutes=1)).replace(tzinfo=None)
    bounds = manifests.Bounds(days="%Y/%m/%d", lookback_days=2)
    found = manifests.discover(spark, str(tmp_path), mark, bounds=bounds)
    assert len(_names_read(found)) == 3
    listed = manifests.present_and_missing(found, str(tmp_path))
    assert {r.folder for r in listed.where("bytes > 0").collect()} == {f"{days[n]}/f" for n in (3, 1, 0)}
    every = manifests.discover(spark, str(tmp_path), bounds=bounds)  # no mark yet
    assert {r.folder for r in every.collect()} == {f"{day}/f" for day in days.values()}


def test_a_declared_feed_passes_its_bounds(spark, tmp_path):
    day = datetime.datetime.now(UTC)
    for name in (f"{day:%Y-%m-%d}", "2020-01-01"):
        write_gz(f"{tmp_path}/{name}/f/d.json.gz", ['{"a": %d}' % len(name)])
        manifest(f"{tmp_path}/{name}/f", [f"{tmp_path}/{name}/f/d.json.gz"], day.timestamp())
    control = record(spark, "Success", 1).withColumn("load_start_time", F.lit(day - datetime.timedelta(hours=1)))
    extract = {"source": "s3", "path": str(tmp_path), "file_format": "jsonl_gz", "discovery": {"method": "manifest", "days": "%Y-%m-%d"}}
    rows = extracted.open_source(spark, extract, SCHEMA, control=control, job_name="job")
    assert [r.source_file.split("/")[-3] for r in rows.collect()] == [f"{day:%Y-%m-%d}"]


def test_folders_land_in_the_shape_they_are_used_in(spark, tmp_path):
    """One copy: the shape is applied between the read and the write, corrupt marks and names are kept."""
    write_gz(f"{tmp_path}/in/data 1+2%.json.gz", ['{"a": 1}', '{"a": "x', '{"a": 3}'])
    write_gz(f"{tmp_path}/in/plain+.json.gz", ['{"a": 1}'])
    names = [f"{tmp_path}/in/data 1+2%.json.gz", f"{tmp_path}/in/plain+.json.gz"]
    found = spark.createDataFrame([("in", n, 1) for n in names], "folder string, data_file string, bytes long")

    def doubled(raw):
        return raw.select("source_file", files.CORRUPT, (F.col("a") * 2).cast("long").alias("twice"))

    root = shared_folder(spark, "land-test")
    assert files.land_folders(spark, found, SCHEMA, f"{root}/group=0", doubled) == []
    raw = files.landed(spark, SCHEMA, root, doubled)
    rows = [(r.source_file.split(":")[-1].replace("//", ""), r[files.CORRUPT], r.twice) for r in raw.collect()]
    assert sorted(rows, key=str) == sorted(
        [(names[0], None, 2), (names[0], '{"a": "x', None), (names[0], None, 6), (names[1], None, 2)], key=str
    )
    outcome = runs.folder_outcomes(found, raw).first()
    assert (outcome.raw_count, outcome.corrupt_count, outcome.status) == (4, 1, "Success")
    assert sorted(r.raw_count for r in runs.file_tracking(raw, "job", datetime.datetime(2024, 2, 1, tzinfo=UTC), found).collect()) == [1, 3]
