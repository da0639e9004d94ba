"""Constraints of targets, damaged files, and records that could not be read."""

from __future__ import annotations

import gzip
import os
import uuid

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.control import runs
from millrace.plans.runner import Destination, read_rejects, run_pipeline, run_spec
from millrace.session import counted, shared_folder
from millrace.sinks import constraints, tables
from millrace.sources import files

DDL = "id BIGINT NOT NULL, email VARCHAR(12) NOT NULL, status STRING DEFAULT 'failed, or not', tries INT DEFAULT 0, price DECIMAL(10,2) DEFAULT NULL, made INT NOT NULL DEFAULT 7"


@pytest.fixture
def target(spark):
    name = f"rules_{uuid.uuid4().hex}"
    tables.create_table(spark, name, DDL, shared_folder(spark, "rules"))
    return name


def test_parse():
    plain, rules = constraints.parse(DDL)
    assert plain == "`id` BIGINT, `email` STRING, `status` STRING, `tries` INT, `price` DECIMAL(10,2), `made` INT"
    assert rules == {
        "not_null": ["id", "email", "made"], "defaults": {"status": "'failed, or not'", "tries": "0", "made": "7"}, "lengths": {"email": 12}}
    assert constraints.parse("a MAP<STRING, INT>, b INT")[1] == {}


def test_defaults_and_violations(spark, target):
    good = spark.createDataFrame([(1, "a@x.org", None)], "id long, email string, tries int")
    for load in (tables.append, tables.replace, lambda df, t: tables.upsert(df, t, ["id"]), lambda df, t: tables.insert_ignore(df, t, ["id"])):
        load(good, target)
        assert [tuple(r) for r in spark.table(target).collect()] == [(1, "a@x.org", "failed, or not", None, None, 7)]
        for bad in (
            good.withColumn("id", F.lit(None).cast("long")), good.withColumn("email", F.lit("longer than it may be")),
        ):
            with pytest.raises(PySparkException, match="required|longer"):
                load(bad, target)
        for bad in (good.drop("email"), good.withColumn("unknown", F.lit(1))):
            with pytest.raises(ValueError, match="required|lacks"):
                load(bad, target)
        assert spark.table(target).count() == 1


def test_a_violating_run_publishes_nothing(spark, target):
    """Neither the bad target nor the good one beside it."""
    other = f"other_{uuid.uuid4().hex}"
    tables.create_table(spark, other, "id BIGINT", shared_folder(spark, "other"))
    rows = spark.createDataFrame([(1, "a"), (2, None)], "id long, email string")
    control = shared_folder(spark, "control")
    with pytest.raises(PySparkException, match="required"):
        run_pipeline("bad", rows, [], [], [Destination(other, columns={"id": "id"}), Destination(target)], control)
    assert spark.table(other).count() == 0 and spark.table(target).count() == 0
    assert [(r.load_status, r.source_count, r.target_count) for r in runs.read_control(spark, control).collect()] == [("Failed", 2, 0)]


def test_mixed_targets_are_refused(spark, target):
    with pytest.raises(ValueError, match="database"):
        run_pipeline("mixed", spark.range(1), [], [], [Destination(target), Destination("t", connection={"engine": "mysql"})], shared_folder(spark, "control"))


def test_declared_csv_rejects_what_it_cannot_read(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.csv").write_text("id,n,s\n1,5,x\n2,abc,y\n3,,z\n4,7\n")
    name, control = f"csv_{uuid.uuid4().hex}", shared_folder(spark, "control")
    spec = {
        "name": "csv", "extract": {"source": "csv", "path": str(tmp_path / "in")}, "transform": {"steps": []},
        "load": {"destinations": [{"table": name, "path": shared_folder(spark, "out"), "target_ddl": "id INT, n INT, s STRING"}]},
    }
    record = run_spec(spark, spec, control, T.StructType.fromDDL("id INT, n INT, s STRING")).first()
    assert sorted(map(tuple, spark.table(name).collect())) == [(1, 5, "x"), (3, None, "z")]
    assert sorted((r.job_name, r.record) for r in read_rejects(spark, control).collect()) == [("csv", "2,abc,y"), ("csv", "4,7")]
    assert (record.source_count, record.target_count) == (4, 2)


def test_counts_do_not_depend_on_the_plan(spark, tmp_path):
    written = str(tmp_path / "t")
    spark.range(1000).write.parquet(written)
    same = spark.read.parquet(written)
    df, n = counted(same)
    assert n == 1000 and df is same  # files are not copied
    df, n = counted(same.limit(10).unionByName(spark.createDataFrame([(1,)], "id long")))
    assert n == 11 and df.inputFiles()


LINE = '{"a": %d}\n'


def pack(path, *members):
    path.write_bytes(b"".join(gzip.compress(m.encode()) for m in members))


def test_gzip_integrity(spark, tmp_path):
    text = "".join(LINE % k for k in range(50_000))
    pack(tmp_path / "good.gz", text, text)
    pack(tmp_path / "empty-member.gz", "")
    (tmp_path / "padded.gz").write_bytes(gzip.compress(b"x") + b"\0" * 100)
    whole = gzip.compress(text.encode())
    (tmp_path / "cut.gz").write_bytes(whole[:-5])
    (tmp_path / "cut in second.gz").write_bytes(whole + whole[:100])
    (tmp_path / "flipped.gz").write_bytes(whole[:2000] + bytes([whole[2000] ^ 255]) + whole[2001:])
    (tmp_path / "trailer.gz").write_bytes(whole[:-8] + b"\1" * 8)
    (tmp_path / "no-gzip.gz").write_text("plain")
    (tmp_path / "plain.json").write_text("plain")
    paths = [str(p) for p in sorted(tmp_path.iterdir())]
    report = files.gzip_integrity(spark, paths)
    found = {os.path.basename(r.file): (r.ok, r.reason) for r in report.collect()}
    assert {n for n, (ok, _) in found.items() if ok} == {"good.gz", "empty-member.gz", "padded.gz", "plain.json"}
    assert found["cut.gz"][1] == found["cut in second.gz"][1] == "cut off" and len(found) == 9


def test_damaged_folders_are_found_in_one_pass(spark, tmp_path, monkeypatch):
    """One bad file of forty folders: two landing jobs and one scan; other failures are raised."""
    rows = []
    for k in range(40):
        (tmp_path / f"f{k}").mkdir()
        path = tmp_path / f"f{k}/a.gz"
        pack(path, LINE % k)
        if k == 13:
            path.write_bytes(path.read_bytes()[:-4])
        rows.append((f"f{k}", str(path), 1))
    found = spark.createDataFrame(rows, "folder string, data_file string, bytes long")
    schema, root = T.StructType.fromDDL("a INT"), shared_folder(spark, "landing")
    landings = []
    real = files._land_files
    monkeypatch.setattr(files, "_land_files", lambda *a: (landings.append(1), real(*a)))
    assert files.land_folders(spark, found, schema, f"{root}/group=0") == ["f13"] and len(landings) == 2
    assert sorted(r.a for r in files.landed(spark, schema, root).collect()) == [k for k in range(40) if k != 13]

    def no_store(*_):
        raise PySparkException("AccessDenied")

    monkeypatch.setattr(files, "_land_files", no_store)
    with pytest.raises(PySparkException, match="AccessDenied"):
        files.land_folders(spark, found.where("folder != 'f13'"), schema, f"{root}/group=1")
