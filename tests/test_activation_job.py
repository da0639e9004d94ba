"""Whole runs over a small feed."""

from __future__ import annotations

import datetime
import gzip
import json
import uuid

import pytest

from millrace.control import runs
from millrace.operators.quality import QualityError
from millrace.plans import activation_job
from millrace.plans.activations import prepare_lookups
from millrace.session import shared_folder
from millrace.sinks import journal, tables

DAY = datetime.date(2024, 2, 1)


@pytest.fixture(scope="module")
def lookups(spark):
    def frame(schema, *rows):
        return spark.createDataFrame(list(rows), schema)

    return prepare_lookups(
        {
            "customers": frame("identity_provider_id string, customer_id string", ("m1", "G1"), ("m2", "G2")),
            "profiles": frame("email string, customer_id string, profile_id string", ("a@x", "G1", "P1")),
            "styles": frame("font_style_id long, pimid long, family_id int", (10, 900, 1), (11, 901, 2)),
            "fonts": frame("font_id long, fontsense_id long, ps_name string", (50, 10, "PSA"), (51, None, "PSB")),
            "usage_types": frame("name string, id long", ("riskScan", 3), ("addedToLibrary", 5)),
            "source_systems": frame("name string, id long", ("Connect", 7)),
            "identifier_types": frame("name string, id long", ("GCID", 9)),
        }
    )


def image(event_id, kind, user, mtf, when, fonts, project=None):
    record = {
        "eventName": {"S": kind},
        "userEmail": {"S": user},
        "mtfid": {"S": mtf},
        "timestamp": {"S": when},
        "teamFonts": {"L": [{"S": f"{ps}:XTS:1:XTS:2:XTS:3:XTS:4:XTS:{fs}:XTS:s"} for ps, fs in fonts]},
    }
    if project:
        record |= {
            "projectId": {"S": project},
            "projectName": {"S": f"Project {project}"},
            "projectType": {"S": "WebProject"},
            "assetType": {"S": "font"},
        }
    return json.dumps({"eventID": str(event_id), "dynamodb": {"NewImage": record}})


def put(folder, files, also_listed=()):
    folder.mkdir(parents=True)
    paths = list(also_listed)
    for name, lines in files.items():
        with gzip.open(folder / name, "wt") as out:
            out.write("\n".join(lines))
        paths.append(str(folder / name))
    (folder / "manifest-files.json").write_text("\n".join(json.dumps({"dataFileS3Key": p}) for p in paths))


def rows(spark, table, *columns):
    return sorted(map(tuple, spark.table(table).select(*columns).collect()), key=str)


def test_runs(spark, tmp_path, lookups):
    feed = tmp_path / "feed"
    control, tracking, root = (shared_folder(spark, p) for p in ("jc", "jt", "jr"))
    names = {t: f"j_{uuid.uuid4().hex}" for t in activation_job.TARGETS}
    activation_job.create_targets(spark, names, root)

    def run():
        return activation_job.ingest(spark, str(feed), lookups, names, control, tracking, DAY).first()

    put(
        feed / "one",
        {
            "a.json.gz": [
                image(1, "riskScan", "a@x", "m1", "2024-01-05T10:00:00Z", [("PSA", 10), ("PSB", 901)]),
                image(2, "riskScan", "a@x", "m1", "2024-01-05T11:00:00Z", [("PSA", 10), ("PSA", 77)]),
                image(3, "riskScan", "a@x", "nobody", "2024-01-05T11:00:00Z", [("PSA", 10)]),
                image(4, "unknown", "a@x", "m1", "2024-01-05T11:00:00Z", [("PSA", 10)]),
                image(5, "riskScan", "b@x", "m2", "2024-01-06T11:00:00Z", [("PSA", 10)]),
                image(6, "riskScan", "a@x", "m1", "2024-01-05T11:00:00Z", []),
                image(7, "addedToLibrary", "b@x", "m2", "2024-01-07T00:00:00Z", [("PSA", 10)], "W1"),
                image(8, "addedToLibrary", "a@x", "m1", "2024-01-08T00:00:00Z", [("PSA", 10)], "W1"),
                '{"dynamodb": {"NewIm',
            ]
        },
    )
    put(feed / "two", {}, also_listed=[str(feed / "two" / "late.json.gz")])
    summary = run()
    assert tuple(summary) == (2, 1, 9, 6, 5, 4, 2 + 2 + 1 + 5)
    assert rows(spark, names["sync_download"], "gcid", "profile_id", "font_style_id", "event_count") == [
        ("G1", "P1", 10, 2),
        ("G1", "P1", 11, 1),
    ]
    assert rows(spark, names["asset"], "project_id", "gcid", "profile_id", "font_style_id") == [
        ("W1", "G1", "P1", 10),
        ("W1", "G2", None, 10),
    ]
    assert rows(spark, names["project"], "id", "name", "gcid", "profile_id") == [
        ("W1", "Project W1", "G2", "P1")
    ]
    usage = ["customer_id", "font_id", "usage_type", "usage_count"]
    first_usage = [
        ("G1", 50, "addedToLibrary", 1),
        ("G1", 50, "riskScan", 2),
        ("G1", 51, "riskScan", 1),
        ("G2", 50, "addedToLibrary", 1),
        ("G2", 50, "riskScan", 1),
    ]
    assert rows(spark, names["usage_data"], *usage) == first_usage

    with gzip.open(feed / "two" / "late.json.gz", "wt") as out:
        out.write(image(9, "riskScan", "a@x", "m1", "2024-01-31T00:00:00Z", [("PSA", 10)]))
    summary = run()
    assert summary.failed_folders == 0 and summary.total_raw_count == 1
    assert rows(spark, names["usage_data"], *usage)[1] == ("G1", 50, "riskScan", 3)
    assert len(rows(spark, names["sync_download"], "gcid")) == 3

    with pytest.raises(QualityError, match="row_count_gt"):
        run()
    statuses = runs.read_control(spark, control).orderBy("load_start_time").collect()
    assert [(r.load_status, r.source_count) for r in statuses] == [("Partial", 9), ("Success", 1), ("Failed", 0)]
    assert spark.table(names["usage_data"]).where("last_modified IS NULL").count() == 0


def test_a_cut_file_is_loaded_once_after_its_repair(spark, tmp_path, lookups):
    feed = tmp_path / "feed"
    control, tracking, root = (shared_folder(spark, p) for p in ("jc", "jt", "jr"))
    names = {t: f"j_{uuid.uuid4().hex}" for t in activation_job.TARGETS}
    activation_job.create_targets(spark, names, root)

    def run():
        return activation_job.ingest(spark, str(feed), lookups, names, control, tracking, DAY).first()

    def lines(first):
        return [image(first + k, "riskScan", "a@x", "m1", f"2024-01-{1 + k % 28:02d}T10:00:00Z", [("PSA", 10)]) for k in range(400)]

    put(feed / "good", {"g.json.gz": lines(0)})
    put(feed / "none", {"n.json.gz": []})
    put(feed / "cut", {"c.json.gz": lines(1000)})
    path = feed / "cut" / "c.json.gz"
    whole = path.read_bytes()
    path.write_bytes(whole[: len(whole) // 2])
    summary = run()
    assert (summary.folders_processed, summary.failed_folders, summary.total_raw_count) == (3, 1, 400)
    path.write_bytes(whole)
    summary = run()
    assert (summary.folders_processed, summary.failed_folders, summary.total_raw_count) == (1, 0, 400)
    total = spark.table(names["usage_data"]).agg({"usage_count": "sum"}).first()[0]
    assert total == 800 and spark.table(names["sync_download"]).agg({"event_count": "sum"}).first()[0] == 800
    tracked = runs.read_tracking(spark, tracking).collect()
    assert sorted(r.raw_count for r in tracked) == [0, 400, 400]
    with pytest.raises(QualityError, match="row_count_gt"):
        run()


def test_a_run_that_dies_while_publishing_is_finished_by_the_next(spark, tmp_path, lookups, monkeypatch):
    feed = tmp_path / "feed"
    control, tracking, root = (shared_folder(spark, p) for p in ("jc", "jt", "jr"))
    names = {t: f"j_{uuid.uuid4().hex}" for t in activation_job.TARGETS}
    activation_job.create_targets(spark, names, root)
    put(feed / "one", {"a.json.gz": [image(k, "riskScan", "a@x", "m1", "2024-01-05T10:00:00Z", [("PSA", 10)]) for k in range(7)]})

    def run():
        return activation_job.ingest(spark, str(feed), lookups, names, control, tracking, DAY).first()

    publish, published = tables.publish, []

    def dying(session, change):
        if len(published) == 1:
            raise KeyboardInterrupt
        publish(session, change)
        published.append(change)

    monkeypatch.setattr(journal, "publish", dying)
    with pytest.raises(KeyboardInterrupt):
        run()
    monkeypatch.undo()
    with pytest.raises(QualityError, match="row_count_gt"):
        run()  # finishes the open batch, then finds no new file
    assert rows(spark, names["sync_download"], "event_count") == [(7,)]
    assert rows(spark, names["usage_data"], "usage_count") == [(7,)]
    assert [r.raw_count for r in runs.read_tracking(spark, tracking).collect()] == [7]
