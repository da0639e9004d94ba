from __future__ import annotations

import pytest

from millrace.operators import quality
from millrace.plans import orders
from millrace.plans.runner import build_checks


@pytest.fixture(scope="module")
def frame(spark):
    data = [(1, "a", 5, "x"), (2, None, 0, "y"), (2, "c", None, None), (None, "d", 101, "z"), (None, "e", 100, "x")]
    return spark.createDataFrame(data, "id int, name string, n int, kind string")


def test_report_counts_every_check(frame):
    checks = build_checks(
        [
            {"row_count_gt": 5},
            {"required_fields_not_null": ["name"]},
            {"column_not_null": ["id"]},
            {"unique_check": {"columns": ["id"]}},
            {"value_range": {"column": "n", "min": 0, "max": 100}},
            {"allowed_values": {"column": "kind", "values": ["x", "y"]}},
        ]
    )
    got = {(r.check_name, r.target): (r.violations, r.passed) for r in quality.report(frame, checks).collect()}
    assert got == {
        ("row_count_gt", "*"): (1, False),
        ("required_fields_not_null", "name"): (1, False),
        ("column_not_null", "id"): (2, False),
        ("unique_check", "id"): (2, False),
        ("value_range", "n"): (2, False),
        ("allowed_values", "kind"): (2, False),
    }


def test_report_of_an_empty_frame(frame):
    checks = build_checks([{"column_not_null": ["id"]}, {"unique_check": {"columns": ["id"]}}])
    got = {r.check_name: (r.violations, r.passed) for r in quality.report(frame.where("false"), checks).collect()}
    assert got == {"row_count_gt": (1, False), "column_not_null": (0, True), "unique_check": (0, True)}


def test_enforce_names_the_failures(frame):
    with pytest.raises(ValueError, match=r"column_not_null\(id\): 2"):
        quality.enforce(frame, build_checks([{"column_not_null": ["id"]}]))
    good = frame.where("id = 1")
    assert quality.enforce(good, build_checks([{"column_not_null": ["id"]}])) is good


def test_missing_column_fails_before_any_job(frame):
    with pytest.raises(quality.QualityError, match="gone"):
        quality.report(frame, quality.not_null(["gone"]))
    assert quality.require_columns(frame, ["id"]) is frame


def test_unknown_check_is_an_error():
    with pytest.raises(ValueError, match="unknown check"):
        build_checks([{"row_count_lt": 3}])


def test_row_checks_take_one_scan(frame):
    checks = build_checks(orders.SUMMARY_CHECKS[:1] + [{"column_not_null": ["id", "name", "n"]}])
    plan = quality.report(frame, checks)._jdf.queryExecution().executedPlan().toString()
    initial = plan.split("Initial Plan")[-1]
    assert initial.count("Scan") == 1 and "hashpartitioning" not in initial


def test_wide_uniqueness_counts_like_the_plain_one(spark, frame):
    repeated = frame.unionByName(frame.where("id IS NULL OR n = 0")).unionByName(frame.where("n = 101"))
    for columns in (["id"], ["name"], ["id", "kind"], ["id", "name", "n", "kind"]):
        plain = quality.report(repeated, quality.unique(columns)).first()
        assert quality.report(repeated, quality.unique(columns, wide=True)).first() == plain
    # NULLs in other places hash alike and are still different keys.
    shifted = spark.createDataFrame([(None, "a"), ("a", None), ("a", None)], "x string, y string")
    assert quality.report(shifted, quality.unique(["x", "y"], wide=True)).first().violations == 1
    assert quality.report(shifted.where("false"), quality.unique(["x"], wide=True)).first().violations == 0
    declared = build_checks([{"unique_check": {"columns": ["x"], "wide": True}}])
    assert declared[-1].kind == "unique_wide"


def test_wide_keys_are_exchanged_only_when_their_hash_repeats(spark):
    rows = spark.range(5000).selectExpr("concat('key ', CAST(id % 4990 AS STRING), repeat('x', 200)) AS k")
    report = quality.report(rows, quality.unique(["k"], wide=True))
    assert report.first().violations == 10
    plan = report._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    above, below = plan.split("BroadcastHashJoin")
    assert "hashpartitioning(k" in above and "hashpartitioning" not in below and "SortMergeJoin" not in plan
