"""Pipelines on small frames, the step runner, and whole runs."""

from __future__ import annotations

import uuid

import pytest
from pyspark.sql import functions as F

from millrace.control import runs
from millrace.operators import quality
from millrace.plans import orders
from millrace.plans.runner import (
    Destination,
    apply_steps,
    build_checks,
    register_step,
    run_pipeline,
    run_spec,
)
from millrace.session import shared_folder
from millrace.sinks import tables
from millrace.sources.extract import open_source

ORDER_SCHEMA = (
    "id string, order_id string, order_name string, email string, attempt_count string, created_at string,"
    "process_at string, last_attempt_on string, status string, is_reprocessed int, font_name string,"
    "variant_title string, source_name string, product_type string, skuid string, eula_id string, md5 string"
)


def order(id_, email, attempts, created, status="success", reprocessed=0, order_id=None):
    return (
        str(id_), order_id or f"A{id_}", f"N{id_}", email, attempts, created, "2023-01-03 10:00:00", None,
        status, reprocessed, " F1 ", None, "Web", "Type", None, None, None,
    )


@pytest.fixture(scope="module")
def raw(spark):
    return spark.createDataFrame(
        [
            order(1, " T@Gmail.com", "0", "2023-01-01 10:00:00"),
            order(2, "t@yahoo.com", "2", "2023-01-02 10:00:00"),
            order(3, None, None, "bad", status=None, reprocessed=1),
            order(4, "x@live.com", "9", "2023-01-01 00:00:00", status="failed"),
            order(5, "t@yahoo.com", "1", None, order_id="A2"),
        ],
        ORDER_SCHEMA,
    )


def test_analytics(raw):
    out = orders.order_analytics(raw).collect()
    assert [r.order_record_id for r in out] == [2, 1, 3]
    yahoo, gmail, unknown = out
    assert (yahoo.email_provider, yahoo.total_attempts, yahoo.attempt_bucket) == ("Yahoo", 2, "moderate")
    assert (gmail.email, gmail.email_provider, gmail.processing_lag_days) == ("t@gmail.com", "Gmail", 2.0)
    assert (unknown.email, unknown.email_domain, unknown.email_provider) == (
        "unknown@unknown.com", "unknown", "Corporate",
    )
    assert (unknown.total_attempts, unknown.attempt_bucket, unknown.is_reprocessed_flag) == (0, None, True)
    assert (unknown.processing_lag_days, unknown.variant_title, unknown.font_id) == (-1.0, "N/A", None)


def test_analytics_checks(raw):
    good = orders.order_analytics(raw).where("attempt_bucket IS NOT NULL")
    quality.enforce(good, build_checks(orders.ANALYTICS_CHECKS))
    with pytest.raises(ValueError, match="allowed_values.attempt_bucket"):
        quality.enforce(orders.order_analytics(raw), build_checks(orders.ANALYTICS_CHECKS))


def test_analytics_plan_shuffles_once_per_need(raw):
    """One exchange for the de-duplication, one for the sort."""
    plan = orders.order_analytics(raw)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 2 and plan.count("WindowGroupLimit") == 2


def test_unknown_step_is_an_error(raw):
    with pytest.raises(ValueError, match="unknown step 'pivot_wider'"):
        apply_steps(raw, [{"pivot_wider": {}}])


def test_string_filter_and_custom_step(raw):
    register_step("shout", lambda df, p: df.withColumn(p["column"], F.upper(p["column"])))
    out = apply_steps(raw, ["filter: id = '1'", {"shout": {"column": "order_name"}, "description": "x"}])
    assert [r.order_name for r in out.collect()] == ["N1"]


def test_enrich_step(spark, raw):
    users = spark.createDataFrame([("1", "gold"), ("1", "iron")], "id string, level string")
    out = apply_steps(
        raw, [{"enrich": {"lookup_table": "users", "join_key": "id", "fields": ["level"]}}], {"users": users}
    )
    assert {r.id: r.level for r in out.collect()} == {"1": "gold", "2": None, "3": None, "4": None, "5": None}


def target(spark, schema):
    name = f"p_{uuid.uuid4().hex}"
    tables.create_table(spark, name, schema, shared_folder(spark, "plantest"))
    return name


def test_run_loads_every_destination_and_records(spark, raw):
    full = target(spark, "id BIGINT, order_name STRING")
    renamed = target(spark, "key STRING, label STRING")
    control = shared_folder(spark, "control-run")
    record = run_pipeline(
        "copy",
        raw,
        [{"drop_columns": {"columns": ["skuid"]}}, {"filter_rows": {"condition": "id < 3"}}],
        [{"column_not_null": ["id"]}],
        [
            Destination(full, "append"),
            Destination(renamed, "insert_ignore", key=("key",), columns={"key": "id", "label": "upper(email)"}),
        ],
        control,
        target_table="copy",
    ).first()
    assert (record.load_status, record.source_count, record.target_count) == ("Success", 5, 2)
    assert spark.table(full).count() == 2
    assert {r.label for r in spark.table(renamed).collect()} == {" T@GMAIL.COM", "T@YAHOO.COM"}


def test_failed_run_loads_nothing_and_is_recorded(spark, raw):
    table = target(spark, "id BIGINT, email STRING")
    control = shared_folder(spark, "control-run")
    with pytest.raises(quality.QualityError, match="email"):
        run_pipeline("copy", raw, [], [{"column_not_null": ["email"]}], [Destination(table)], control)
    assert spark.table(table).count() == 0
    row = runs.read_control(spark, control).first()
    assert (row.load_status, row.source_count, row.target_count) == ("Failed", 5, 0)


def test_run_spec_from_csv_upserts_daily_sales(spark, tmp_path):
    import datetime

    from millrace.plans import daily

    path = str(tmp_path / "sales.csv")
    with open(path, "w") as out:
        out.write("order_id,customer_id,product_id,quantity,unit_price,region,order_date,payment_method\n")
        out.write("1,1,1,2,10.5,EU,2024-01-01,card\n1,9,1,5,1.0,EU,2024-01-01,card\n2,1,1,1,3.0,EU,2024-01-01,cash\n")
    name = f"p_{uuid.uuid4().hex}"
    spec = {
        "pipeline": {
            "name": "daily_sales",
            "extract": {"source": "csv", "path": path, "columns": daily.SALES_SCHEMA.fieldNames()},
            "transform": {"steps": daily.SALES_STEPS},
            "quality_checks": {"pre_load": daily.SALES_CHECKS},
            "load": {
                "destinations": [
                    {
                        "table": name,
                        "path": shared_folder(spark, "spec"),
                        "target_ddl": "region STRING, order_date DATE, total_revenue DOUBLE, order_count BIGINT,"
                        "avg_order_value DOUBLE, load_timestamp TIMESTAMP",
                        "mode": "upsert",
                        "upsert_key": ["region", "order_date"],
                    }
                ]
            },
        }
    }
    control = shared_folder(spark, "spec-control")
    day = datetime.date(2024, 1, 2)
    for _ in range(2):
        run_spec(spark, spec, control, daily.SALES_SCHEMA, execution_date=day)
    assert [tuple(r)[:5] for r in spark.table(name).collect()] == [("EU", datetime.date(2024, 1, 1), 24.0, 2, 12.0)]
    assert [(r.load_status, r.source_count, r.load_date) for r in runs.read_control(spark, control).collect()] == [
        ("Success", 3, day)
    ] * 2


def test_run_spec_reads_a_feed_once(spark, tmp_path):
    """The second run finds nothing newer than the first and fails its row count check."""
    import gzip
    import json

    from pyspark.sql import types as T

    folder = tmp_path / "feed" / "one"
    folder.mkdir(parents=True)
    with gzip.open(folder / "d.json.gz", "wt") as out:
        out.write('{"a": 1}\n{"a": 2}\n')
    (folder / "manifest-files.json").write_text(json.dumps({"dataFileS3Key": str(folder / "d.json.gz")}))
    name, control = f"p_{uuid.uuid4().hex}", shared_folder(spark, "feed-control")
    spec = {
        "name": "feed",
        "extract": {
            "source": "s3",
            "path": str(tmp_path / "feed"),
            "file_format": "jsonl_gz",
            "discovery": {"method": "manifest"},
        },
        "transform": [{"select_columns": {"columns": ["a"]}}],
        "quality_checks": {"pre_load": [{"row_count_gt": 0}]},
        "load": {"destinations": [{"table": name, "path": shared_folder(spark, "feed-out"), "target_ddl": "a BIGINT"}]},
    }
    schema = T.StructType([T.StructField("a", T.LongType())])
    run_spec(spark, spec, control, schema)
    with pytest.raises(quality.QualityError, match="row_count_gt"):
        run_spec(spark, spec, control, schema, control=runs.read_control(spark, control))
    assert sorted(r.a for r in spark.table(name).collect()) == [1, 2]
    assert sorted(r.load_status for r in runs.read_control(spark, control).collect()) == ["Failed", "Success"]


def test_open_source_kinds(spark):
    with pytest.raises(ValueError, match="unknown source"):
        open_source(spark, {"source": "ftp"})
    with pytest.raises(ValueError, match="schema"):
        open_source(spark, {"source": "csv", "path": "/nowhere"})
    name = target(spark, "id BIGINT")
    tables.append(spark.range(9), name)
    assert open_source(spark, {"source": "table", "table": name, "row_limit": 4}).count() == 4
